"""The pipeline's stages, each against plain Python or SQL on what the stage before kept."""

from __future__ import annotations

from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pseudosignal.llm.oracle import mixing_sql

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest table, and rows with NULLs, blanks, repeats and a hot source."""
    folder = str(tmp_path_factory.mktemp("sf"))
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [
        (90001, None, None, None, None),
        (90002, "", "en", "hot", 0),
        (90003, "1234 !!", "en", "hot", 7),
        (None, "a text without an id", "en", "hot", 20),
        (90004, "password=abcdef123456 in a text", "en", "hot", 31),
        *[(90100 + i, "the very same words again and again and once more", "en", "hot", 50) for i in range(40)],
        (90005, "one", "en", "hot", 3),
        (90005, "one", "en", "hot", 3),
    ]
    given.unionByName(spark.createDataFrame(odd, given.schema)).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def kept(spark, corpus):
    """Rows after each stage, the given ones first."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    tables = [docs]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, corpus)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == tables[0].columns
            path = f"{corpus}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        tables.append(docs)
    return tables


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_are_those_of_the_contract():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "secret_scan", "source_mixing", "packing"]


def test_language(kept):
    want = [r for r in rows(kept[0]) if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter(rows(kept[1])) == Counter(want)


def shingles(text):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = low.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(kept):
    before = sorted({r for r in rows(kept[1]) if r[0] is not None})
    sets = {r[0]: shingles(r[1]) for r in before}
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    want = [r for r in before if root(r[0]) == r[0]] + [r for r in rows(kept[1]) if r[0] is None]
    assert Counter(rows(kept[2])) == Counter(want)


def test_secrets_are_masked_and_nothing_else(kept):
    before = {r[0]: r for r in rows(kept[2])}
    after = {r[0]: r for r in rows(kept[3])}
    assert set(before) == set(after)
    assert "abcdef123456" not in after[90004][1] and after[90004][1].endswith(" in a text")
    changed = [i for i in before if before[i][1] != after[i][1]]
    assert 90100 not in changed and len(changed) < len(before) / 2


def test_mixing_takes_what_the_sql_says(kept, corpus):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{corpus}/secret_scan/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(f"select doc_id, sum(taken) from ({mixing_sql()}) group by 1").fetchall()}
    got = Counter()
    for doc_id, text, *_ in rows(kept[4]):
        got[doc_id] += len(text.encode().split())
    assert {i: n for i, n in want.items() if n} == dict(got)


def test_packing_restores_the_tokens(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text, *_ in rows(kept[4]):
        want[doc_id] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in kept[5].collect():
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0
        got[r["doc_id"]] += r["length"]
    assert got == want
