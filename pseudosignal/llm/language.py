"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on its code point only. The
vector of a letter n-gram binds (multiplies) the vectors of its letters, each permuted
(rotated) by its distance from the end. A text bundles (adds) the vectors of its n-grams, a
language those of its texts, each text weighing the same. A document gets the language
whose prototype has the largest cosine with it.

Bundling is linear, so a text is counted first and only its distinct n-grams are bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.llm.common import id_text, small_batches, table

DIMENSIONS = 1024
N = 3
SEED = 9
UNDETERMINED = "und"
FOLDS, HELD_OUT_FOLD = 4, 2
# n-gram vectors that a worker remembers: 32 MiB of signs.
REMEMBERED = 32_768
# n-gram vectors that are weighed at once: 8 MiB of floats.
WEIGHED = 2048
# Code points of one step over a very long text.
CHUNK = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of every letter; 0, the word gap, for everything else."""
    found = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            found[code] = ord(low) if len(low) == 1 else code
    return found


@lru_cache(maxsize=8192)
def _letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=[seed, code])).integers(
        0, 2, dimensions, dtype=np.int8
    )
    return 2 * bits - 1


class Profiles:
    """Counts of n-grams, and bundles of their vectors. What it remembers lasts as long as its task,
    so that a worker process that goes on to other work holds none of it."""

    def __init__(self, n: int, dimensions: int, seed: int) -> None:
        self.n, self.dimensions, self.seed = n, dimensions, seed
        self.vectors = np.empty((REMEMBERED, dimensions), np.int8)
        self.known: dict[int, int] = {}

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, packed 21 bits to a letter, and how often they occur.

        Everything between letters is one gap, also before and after the text; n-grams of
        gaps only do not count."""
        codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        letters = _letters()[codes]
        if not letters.any():
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        letters = np.concatenate([[0], letters, [0]]).astype(np.uint64)
        letters = letters[np.concatenate([[True], (letters[1:] != 0) | (letters[:-1] != 0)])]
        if len(letters) < self.n:
            letters = np.concatenate([letters, np.zeros(self.n - len(letters), np.uint64)])
        parts = []
        # A long text is reduced chunk by chunk.
        for start in range(0, len(letters) - self.n + 1, CHUNK):
            some = letters[start : start + CHUNK + self.n - 1]
            grams = np.zeros(len(some) - self.n + 1, np.uint64)
            for i in range(self.n):
                grams = (grams << np.uint64(21)) | some[i : len(some) - self.n + 1 + i]
            parts.append(np.unique(grams, return_counts=True))
        if len(parts) == 1:
            return parts[0]
        grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def _bound(self, gram: int) -> np.ndarray:
        product = np.ones(self.dimensions, np.int8)
        for i in range(self.n):
            code = gram >> 21 * i & 0x1FFFFF
            product = product * np.roll(_letter_vector(code, self.dimensions, self.seed), i)
        return product

    def bundle(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions, np.float64)
        # Never more at once than is remembered, whatever the script.
        for start in range(0, len(grams), WEIGHED):
            some = grams[start : start + WEIGHED].tolist()
            known = self.known
            if len(known) + len(some) > REMEMBERED:
                known.clear()
            for gram in some:
                if gram not in known:
                    self.vectors[len(known)] = self._bound(gram)
                    known[gram] = len(known)
            rows = np.fromiter(map(known.__getitem__, some), np.int64, len(some))
            part = weights[start : start + WEIGHED].astype(np.float32)
            total += part @ self.vectors[rows].astype(np.float32)
        return total


def _learned(batches: Iterator[pa.RecordBatch], n: int, dimensions: int, seed: int):
    """Bundle of each language over one task: a few rows, however many documents."""
    profiles = Profiles(n, dimensions, seed)
    weights: dict[str, dict[int, float]] = {}
    texts: dict[str, int] = {}
    totals: dict[str, np.ndarray] = {}

    def flush(lang: str) -> None:
        found = weights.pop(lang, {})
        grams = np.fromiter(found.keys(), np.uint64, len(found))
        values = np.fromiter(found.values(), np.float64, len(found))
        old = totals.get(lang, np.zeros(dimensions))
        totals[lang] = old + profiles.bundle(grams, values)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            grams, counts = profiles.count(text.as_py() or b"")
            if not len(grams):
                continue
            own = weights.setdefault(lang, {})
            share = 1.0 / float(counts.sum())
            for gram, count in zip(grams.tolist(), counts.tolist(), strict=True):
                own[gram] = own.get(gram, 0.0) + count * share
            texts[lang] = texts.get(lang, 0) + 1
            if len(own) > 4 * REMEMBERED:
                flush(lang)
    for lang in list(weights):
        flush(lang)
    if totals:
        langs = sorted(totals)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(langs),
                pa.array([texts[x] for x in langs], pa.int64()),
                pa.array([totals[x].tolist() for x in langs], pa.list_(pa.float64())),
            ],
            names=["lang", "texts", "bundle"],
        )


def learn(
    labelled: DataFrame, n: int = N, dimensions: int = DIMENSIONS, seed: int = SEED
) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from columns lang and text of all rows given.

    Each task bundles its own rows; bundles of tasks are added element by element. One
    vector for each language reaches the driver.
    """
    small_batches(labelled.sparkSession)
    bundles = (
        labelled.where("lang is not null and text is not null")
        .select(F.col("lang").cast("string"), F.col("text").cast("binary"))
        .mapInArrow(
            lambda batches: _learned(batches, n, dimensions, seed),
            "lang string, texts bigint, bundle array<double>",
        )
    )
    rows = (
        bundles.select("lang", F.posexplode("bundle"))
        .groupBy("lang", "pos")
        # Rounded, so that the order of addition does not show.
        .agg(F.sum(F.round("col", 9).cast("decimal(30,9)")).cast("double").alias("x"))
        .toArrow()
    )
    langs = sorted(set(rows["lang"].to_pylist()))
    prototypes = np.zeros((len(langs), dimensions))
    place = {lang: i for i, lang in enumerate(langs)}
    at = [place[x] for x in rows["lang"].to_pylist()]
    prototypes[at, rows["pos"].to_numpy()] = rows["x"].to_numpy()
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return langs, prototypes / np.where(norms > 0, norms, 1)


def identify(
    docs: DataFrame,
    langs: list[str],
    prototypes: np.ndarray,
    n: int = N,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with lang_pred and score (cosine, at least 0) behind its own columns.

    A text that is NULL or has no letter is undetermined with score 0, and so is every text
    if no language was learned. Equal cosines go to the first language by code point.
    Needs text; columns of ``docs`` named lang_pred or score must be renamed before.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names, dimensions = docs.columns, prototypes.shape[1]
    if {"lang_pred", "score"} & set(names):
        raise ValueError("lang_pred and score are columns of the result")
    schema = docs.limit(0).select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(n, dimensions, seed)
        for batch in batches:
            found, scores = [], []
            for text in batch.column(at):
                grams, counts = profiles.count((text.as_py() or "").encode())
                best, score = UNDETERMINED, 0.0
                if len(grams) and langs:
                    vector = profiles.bundle(grams, counts)
                    norm = float(np.linalg.norm(vector))
                    if norm > 0:
                        cosines = prototypes @ (vector / norm)
                        k = int(np.argmax(cosines))
                        best, score = langs[k], min(1.0, max(0.0, float(cosines[k])))
                found.append(best)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold, as lang and text."""
    return docs.where(id_text() % FOLDS != HELD_OUT_FOLD).select("lang", "text")


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``, learned from the rows of the
    other folds. A NULL doc_id is neither learned from nor held out."""
    langs, prototypes = learn(learning_rows(docs))
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return identify(slim, langs, prototypes).select(
        "doc_id",
        F.coalesce(id_text() % FOLDS == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def with_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are in some language: undetermined ones go. Columns stay as they are."""
    langs, prototypes = learn(learning_rows(docs))
    # Plain names, so that no column clashes with those of the result; each text travels once.
    plain = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    kept = identify(docs.toDF(*plain), langs, prototypes).where(F.col("lang_pred") != UNDETERMINED)
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return predict_languages(table(spark, sf_dir, "documents"))
