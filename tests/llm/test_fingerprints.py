"""Fingerprints and the search in block tables against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from pseudosignal.llm import fingerprints as fp
from pseudosignal.llm import simhash as sh


def bits_apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def expected(rows):
    """Results by sorting the whole table."""
    def tie(text):
        return hashlib.md5((text or "").encode()).hexdigest()

    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    out = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        moved = len(text) // 3
        edited = (text[: len(text) - moved] + after[:moved]).encode()
        own, next_, late = (sh.simhash(x).hex() for x in (text.encode(), after.encode(), edited))
        out.append(
            (doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, late, fp.likeness(own, late), fp.likeness(own, next_))
        )
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in fp.edited_fingerprints(docs).collect()), key=str)


def test_odd_rows(edges):
    assert got(edges) == expected([tuple(r) for r in edges.select("doc_id", "text").collect()])


@pytest.mark.parametrize("count", [1, 2, 100])
def test_ends_of_ranges_meet(docs_of, count):
    rng = random.Random(count)
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta eps".split(), k=rng.randint(0, 60)))) for i in range(count)]
    docs = docs_of(rows).repartition(5)
    assert got(docs) == expected(rows)


def test_repeated_rows(docs_of):
    rows = [(7, "the very same text")] * 60 + [(i, f"text number {i}") for i in range(20)]
    assert got(docs_of(rows)) == expected(rows)


def test_empty_table(docs_of):
    assert got(docs_of([(1, "a")]).where("false")) == []


def test_settings_of_the_session_stay(spark, docs_of):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got(docs_of([(1, "a b c")]))
    assert spark.conf.get(key) == before


def test_blocks_of_a_long_text_do_not_matter(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcXYZé東", k=rng.randint(1, 30))) for _ in range(3000)).encode()
    whole = sh.simhash(text)
    monkeypatch.setattr(sh, "BLOCK", 500)
    assert sh.simhash(text) == whole


def test_votes_are_those_of_the_terms():
    """One bit at a time, from the same term hashes."""
    text = b"a b a b c a b and so on and so on and so forth"
    words = [int(w) for w in sh.words_of(text)]
    assert len(words) == 16 and len(set(words)) == 7
    terms = [int(t) for t in sh.terms_of(sh.words_of(text), 2)]
    counts = {t: terms.count(t) for t in terms}
    value = 0
    for bit in range(sh.BITS):
        vote = 0
        for term, count in counts.items():
            half = term if bit < 64 else int(sh._mixed(sh.np.array([term], sh.np.uint64) + sh.np.uint64(1))[0])
            place = bit % 64
            one = half.to_bytes(8, "little")[place // 8] >> (7 - place % 8) & 1
            vote += count.bit_length() * (1 if one else -1)
        value = value << 1 | (vote > 0)
    assert int.from_bytes(sh.simhash(text), "big") == value


def test_case_and_space_do_not_matter():
    assert sh.simhash(b"One  two\tTHREE\n") == sh.simhash(b"one two three")
    assert sh.simhash(b"") == sh.simhash(b" \t") == bytes(16)


def prints(rng, count):
    """Fingerprints of which many are a few bits apart, and many share a block."""
    seeds = [rng.getrandbits(128) for _ in range(4)]
    out = []
    for _ in range(count):
        value = rng.choice(seeds)
        for _ in range(rng.choice([0, 1, 2, 3, 9])):
            value ^= 1 << rng.randrange(128)
        out.append(f"{value:032x}")
    return out


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
@pytest.mark.parametrize("part", [4096, 7])
def test_search_finds_all_within_the_radius(spark, monkeypatch, radius, part):
    monkeypatch.setattr(fp, "PART", part)
    values = prints(random.Random(radius), 150)
    table = spark.createDataFrame([(v, 1) for v in values] + [(None, 2)], "fingerprint string, n int")
    distinct = sorted(set(values))
    near = {
        (a, b, bits_apart(a, b))
        for i, a in enumerate(distinct)
        for b in distinct[i + 1 :]
        if bits_apart(a, b) <= radius
    }
    found = [tuple(r) for r in fp.near_pairs(table, radius).collect()]
    assert len(found) == len(near) and set(found) == near
    counts = {r[0]: r[1] for r in fp.near_counts(table, radius).collect()}
    assert counts == {a: sum(bits_apart(a, b) <= radius for b in values) - 1 for a in distinct}


def test_radius_must_fit_the_blocks(spark):
    with pytest.raises(ValueError):
        fp.near_pairs(spark.createDataFrame([("0" * 32,)], "fingerprint string"), 4)


def test_edited_texts_are_nearer_than_others(spark):
    rows = fp.op12_document_fingerprints(spark, "/root/testdata/sf0.01").collect()
    long = [r for r in rows if r["n_chars"] > 200]
    assert len(rows) == 1000
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.99 * len(long)
