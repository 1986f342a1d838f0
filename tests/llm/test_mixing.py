from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import pytest

from pseudosignal.llm import mixing

from .conftest import EDGES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict) -> dict:
    """Shares by weight; whoever is above three times its size stops there, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        share = sum(weight[s] for s in rest)
        left = total - sum(capped.values())
        now = {s: Fraction(left * weight[s], share) for s in rest} if share else {}
        over = [s for s in rest if now[s] > 3 * sizes[s]]
        if not over:
            return {s: float(capped.get(s, now.get(s, 0))) for s in order}
        capped |= {s: 3 * sizes[s] for s in over}


def check(docs):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    texts = docs.collect()
    assert len(rows) == len(texts)
    sizes: dict = {}
    for r in texts:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    want = targets(sizes)
    taken: dict = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    repeats = {s: sum(r["source"] == s for r in texts) for s in sizes}
    for source, words in taken.items():
        # Rows equal in id and text may leave a word each.
        assert abs(words - want[source]) <= 0.5 + (repeats[source] if docs_repeat(texts) else 0)
    return rows


def docs_repeat(texts) -> bool:
    return len({(r["doc_id"], r["text"]) for r in texts}) < len(texts)


def documents(n: int) -> list:
    """A hot source, a tiny one that is capped, one without words, and the NULL source."""
    rows = []
    for i in range(n):
        source = ("hot", "hot", "b", "c", None, "hot", "d")[i % 7]
        words = 1 + int(hashlib.md5(str(i).encode()).hexdigest()[:2], 16) % 40
        rows.append((i, " ".join(["w"] * words), "en", source))
    return rows + [(n, "two words", "en", "tiny"), (n + 1, " ", "en", "void")]


def test_targets_and_budgets(docs_of, monkeypatch):
    docs = docs_of(documents(300))
    whole = sorted(check(docs), key=lambda r: r["doc_id"])
    # The same result with many key ranges.
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)
    again = sorted(check(docs.repartition(5)), key=lambda r: r["doc_id"])
    assert whole == again


def test_edges(edges):
    check(edges)


def test_no_rows(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.mixed_documents(docs_of([])).count() == 0


def test_only_empty_texts(docs_of):
    rows = mixing.mix(docs_of([(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_documents_are_taken_as_the_mix_says(docs_of):
    docs = docs_of(documents(100))
    words: dict = {}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    assert words == want


def test_plan_has_no_python(docs_of):
    plan = mixing.mix(docs_of([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert EDGES
