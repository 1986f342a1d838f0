"""Toxicity classifier with counterfactual regularisation.

A logistic model over words and word beginnings of whole texts, trained on a bounded sample
of labelled documents. In sentences of the sample that mention a group, the term is swapped
for another of its kind; the squared change of the score is a penalty of the fit. Mentions
of a group, toxic by mere association in the sample, so lose their weight.

Words are counted by Spark; the features that tell classes apart, and the sample in terms
of these, are small and bounded, and the model is fitted on them with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.llm.common import (
    id_text,
    maybe_in,
    membership_map,
    small_batches,
    stored,
    table,
)

FOLDS, HELD_OUT_FOLD = 5, 0
# Labelled documents that the model is fitted on, at most (chosen by hash).
SAMPLE_DOCS = 20_000
# Features of the model, at most: those with the largest likelihood ratio statistic.
MAX_FEATURES = 4096
MIN_STATISTIC = 10.0
# Letters (bytes) of a word's beginning.
BEGINNING = 5
PENALTY, RIDGE, STEPS = 4.0, 1e-3, 400
REMEMBERED_WORDS = 400_000
# Swaps of the sample that enter the penalty, at most; each has a few features.
MAX_SWAPS = 50_000

# Terms of one line are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)

_STRIP = b".,;:!?\"'()[]{}|"
_SENTENCE = re.compile(rb"[.!?\n]+")


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The word, and its beginning if it is longer than that."""
    word = word.strip(_STRIP)
    if not word:
        return ()
    return (b"w" + word, b"b" + word[:BEGINNING]) if len(word) > BEGINNING else (b"w" + word,)


def _all_features(words) -> set[bytes]:
    return {f for word in set(words) for f in features_of(word)}


def _swaps() -> dict[bytes, list[bytes]]:
    found: dict[bytes, list[bytes]] = {}
    for line in IDENTITY_TERMS:
        each = [t.encode() for t in line]
        for term in each:
            found[term] = [t for t in each if t != term]
    return found


def _sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(toxic, text) of the labelled documents to learn from. Repeated labels: toxic wins."""
    known = (
        labels.where("toxic is not null and doc_id is not null")
        .where(id_text() % FOLDS != HELD_OUT_FOLD)
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    share = min(1.0, sample_docs / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    near = maybe_in(texts.where("doc_id is not null"), "doc_id", membership_map(chosen, "doc_id"))
    return near.join(chosen, "doc_id").select("toxic", F.coalesce("text", F.lit(b"")).alias("text"))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, docs): documents of this batch that have a feature."""
    for batch in batches:
        counts: dict[tuple[bytes, int], int] = {}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for feature in _all_features(text.as_py().lower().split()):
                key = (feature, toxic)
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.binary()),
                pa.array([k[1] for k in counts], pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["feature", "toxic", "docs"],
        )


def _selected(sample: DataFrame, terms: list[bytes], max_features: int) -> list[bytes]:
    """Features whose frequency differs between the classes; identity terms are always in."""
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    counts = (
        sample.mapInArrow(_feature_rows, "feature binary, toxic int, docs bigint")
        .groupBy("feature")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("b"),
        )
        .where("a + b > 1")
    )
    share = toxic / (toxic + clean)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    n = F.col("a") + F.col("b")
    statistic = 2 * (part(F.col("a"), n * share) + part(F.col("b"), n * (1 - share)))
    best = (
        counts.withColumn("statistic", statistic)
        .where(F.col("statistic") >= MIN_STATISTIC)
        .orderBy(F.desc("statistic"), "feature")
        .limit(max_features)
    )
    found = {bytes(r["feature"]) for r in best.select("feature").collect()}
    return sorted(found | {f for term in terms for f in features_of(term)})


def _encoded(batches: Iterator[pa.RecordBatch], index: dict[bytes, int], swaps: dict):
    """Documents as lists of feature numbers; for sentences with identity terms also the features
    that a swap takes away and brings in, instead of a label."""
    columns: list[list] = [[], [], []]

    def known(words) -> set[int]:
        return {index[f] for f in _all_features(words) if f in index}

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py().lower()
            words = text.split()
            columns[0].append(toxic)
            columns[1].append(sorted(known(words)))
            columns[2].append([])
            if swaps.keys().isdisjoint({w.strip(_STRIP) for w in words}):
                continue
            for sentence in _SENTENCE.split(text):
                words = [w.strip(_STRIP) for w in sentence.split()]
                own = known(words)
                for term in swaps.keys() & set(words):
                    for other in swaps[term]:
                        changed = known([other if w == term else w for w in words])
                        if changed != own:
                            columns[0].append(None)
                            columns[1].append(sorted(own - changed))
                            columns[2].append(sorted(changed - own))
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["toxic", "plus", "minus"],
        )
        columns = [[], [], []]


def _sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones of a matrix."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.fromiter((v for x in lists for v in x), np.int64, len(rows))


def fit(toxic: np.ndarray, docs: list, swaps: list, n_features: int, penalty: float = PENALTY):
    """Weights and intercept: logistic loss + ridge + penalty times the mean squared change of the
    logit over the swaps (pairs of features taken away and brought in). Adam, fixed steps."""
    rows, cols = _sparse(docs)
    out_rows, out_cols = _sparse([s[0] for s in swaps])
    in_rows, in_cols = _sparse([s[1] for s in swaps])
    share = np.clip(toxic.mean(), 1e-3, 1 - 1e-3)
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        logit = np.bincount(rows, theta[cols], len(docs)) + theta[-1]
        error = (1 / (1 + np.exp(-logit)) - toxic) / len(docs)
        gradient = np.zeros_like(theta)
        gradient[:-1] = np.bincount(cols, error[rows], n_features) + RIDGE * theta[:-1]
        gradient[-1] = error.sum()
        if swaps and penalty:
            change = np.bincount(out_rows, theta[out_cols], len(swaps)) - np.bincount(
                in_rows, theta[in_cols], len(swaps)
            )
            pull = 2 * penalty * change / len(swaps)
            gradient[:-1] += np.bincount(out_cols, pull[out_rows], n_features)
            gradient[:-1] -= np.bincount(in_cols, pull[in_rows], n_features)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        rate = 0.1 * (1 - 0.9 * step / STEPS)
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    max_features: int = MAX_FEATURES,
    penalty: float = PENALTY,
) -> tuple[dict[bytes, float], float]:
    """Weight of each feature, and the intercept. Without rows of both classes: no weights, and an
    intercept that scores 0 or 1 throughout (0 without any row)."""
    small_batches(docs.sparkSession)
    sample = stored(_sample(docs, labels, sample_docs), "toxicity-sample")
    swaps = _swaps()
    chosen = _selected(sample, sorted(swaps), max_features)
    if not chosen:
        top = sample.agg(F.max("toxic")).first()[0]
        return {}, 50.0 if top == 1 else -50.0
    index = {f: i for i, f in enumerate(chosen)}
    rows = sample.mapInArrow(
        lambda batches: _encoded(batches, index, swaps),
        "toxic int, plus array<int>, minus array<int>",
    )
    known = rows.where("toxic is not null").select("toxic", "plus").toArrow()
    swapped = (
        rows.where("toxic is null").orderBy(F.xxhash64("plus", "minus")).limit(MAX_SWAPS).toArrow()
    )
    pairs = list(zip(swapped["plus"].to_pylist(), swapped["minus"].to_pylist(), strict=True))
    weights, intercept = fit(
        known["toxic"].to_numpy().astype(float), known["plus"].to_pylist(), pairs, len(chosen), penalty
    )
    return dict(zip(chosen, weights.tolist(), strict=True)), intercept


class _Hits(dict):
    """Numbers of a word's features in the model, None for almost all words."""

    def __init__(self, index: dict[bytes, int]) -> None:
        self.index = index

    def __missing__(self, word: bytes):
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        found = tuple(self.index[f] for f in features_of(word) if f in self.index) or None
        self[word] = found
        return found


def score(docs: DataFrame, weights: dict[bytes, float], intercept: float) -> DataFrame:
    """(doc_id, score) for each row of ``docs``. NULL and empty texts get the intercept's score."""
    small_batches(docs.sparkSession)
    names = sorted(weights)
    values = np.array([weights[f] for f in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits({f: i for i, f in enumerate(names)})
        for batch in batches:
            logits = []
            for text in batch.column(1):
                words = set((text.as_py() or b"").lower().split())
                found = {i for h in set(map(hits.__getitem__, words)) if h for i in h}
                logits.append(intercept + float(values[sorted(found)].sum()))
            scores = 1 / (1 + np.exp(-np.clip(np.array(logits), -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Learned from ``labels`` (doc_id, toxic) outside the held-out fold; a NULL doc_id is in
    no fold and has no label. Other columns are ignored. An empty table gives no rows.
    """
    weights, intercept = train(docs, labels, **settings)
    return score(docs, weights, intercept).select(
        "doc_id",
        F.coalesce(id_text() % FOLDS == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
