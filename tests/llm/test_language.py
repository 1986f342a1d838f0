from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pseudosignal.llm import language

from .conftest import EDGES

LETTERS = {"en": "theandingofr", "de": "schüßungeint", "ru": "привет мирда", "el": "καλημερας"}


def text(lang: str, words: int, seed: int) -> str:
    r = random.Random(f"{lang}{seed}")
    word = lambda: "".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 8)))
    return " ".join(word() for _ in range(words))


def test_held_out_rows_are_recognised(docs_of):
    rows = [
        (4 * i + k, text(lang, 5 + i % 30, i), lang)
        for i in range(40)
        for k, lang in enumerate(LETTERS)
    ]
    found = language.predict_languages(docs_of(rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_held_out_languages_are_not_learned(docs_of):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, text("en", 30, i), "xx" if i in ids else "en") for i in range(100)]
    found = language.predict_languages(docs_of(rows)).collect()
    assert {r["lang_pred"] for r in found} == {"en"}


def test_edges(edges):
    rows = language.predict_languages(edges).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        if r["doc_id"] in (4, 5, 6, 7):
            assert r["lang_pred"] == "en"
        if r["doc_id"] is None:
            assert not r["held_out"]
    kept = language.with_language(edges)
    assert kept.columns == edges.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.collect())
    assert ids == [0, 4, 5, 5, 6, 7]


def test_no_rows_and_no_labels(docs_of):
    assert language.predict_languages(docs_of([])).count() == 0
    rows = language.predict_languages(docs_of([(1, "some words", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]


def test_bundle_is_the_sum_of_bound_vectors():
    """Counting first gives what binding every n-gram of the text one by one gives."""
    profiles = language.Profiles(3, 256, 9)
    sample = "Ab, ba! " * 3 + "x"
    padded = [0, *(ord(c) if c.isalpha() else 0 for c in sample.lower()), 0]
    letters = [c for i, c in enumerate(padded) if i == 0 or c or padded[i - 1]]
    want = np.zeros(256)
    for i in range(len(letters) - 2):
        bound = np.ones(256)
        for k, code in enumerate(reversed(letters[i : i + 3])):
            bound *= np.roll(language._letter_vector(code, 256, 9), k)
        want += bound
    grams, counts = profiles.count(sample.encode())
    assert counts.sum() == len(letters) - 2
    assert np.array_equal(profiles.bundle(grams, counts), want)


def test_long_texts_are_counted_in_chunks(monkeypatch):
    profiles = language.Profiles(3, 64, 9)
    sample = text("de", 500, 1).encode()
    whole = profiles.count(sample)
    monkeypatch.setattr(language, "CHUNK", 17)
    parts = profiles.count(sample)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert np.allclose(profiles.bundle(*whole), profiles.bundle(*parts))


def test_result_columns_must_be_free(spark):
    with pytest.raises(ValueError):
        language.identify(
            spark.createDataFrame([("a", 1.0)], "text string, score double"), ["en"], np.ones((1, 8))
        )
