from __future__ import annotations

import random
import zlib

import numpy as np

from pseudosignal.llm import toxicity

from .conftest import EDGES

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n: int, rude_of_group: float = 0.0):
    """Toxic documents hold rude words; with some probability also a mention of a group."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 4 == 0)
        words = [word() for _ in range(r.randint(3, 80))]
        if toxic:
            for rude in r.sample(["nitwit", "blockhead", "dunce", "muppet"], 2):
                words.insert(r.randrange(len(words)), rude)
            if r.random() < rude_of_group:
                words.insert(0, "women")
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_rows(spark, docs_of):
    docs, labels = corpus(400)
    found = toxicity.classify(docs_of(docs), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    assert len(found) == len(docs)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_held_out_labels_are_not_learned(spark, docs_of):
    docs, labels = corpus(200)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (
        toxicity.train(docs_of(docs), spark.createDataFrame(x, LABELS)) for x in (labels, other)
    )
    assert one == two


def test_penalty_takes_the_weight_of_mere_mentions(spark, docs_of):
    docs, labels = corpus(300, rude_of_group=0.9)
    tables = docs_of(docs), spark.createDataFrame(labels, LABELS)
    plain, _ = toxicity.train(*tables, penalty=0.0)
    fair, _ = toxicity.train(*tables, penalty=20.0)
    assert abs(fair[b"wwomen"] - fair[b"wmen"]) < 0.3 * abs(plain[b"wwomen"] - plain[b"wmen"])
    assert fair[b"wnitwit"] > 1


def test_fit_pulls_swapped_features_together():
    toxic = np.array([1.0, 1.0, 0.0, 0.0] * 5)
    docs = [[0], [0, 1], [], [1]] * 5
    weights, _ = toxicity.fit(toxic, docs, [([0], [2])] * 10, 3, penalty=1e4)
    assert abs(weights[0] - weights[2]) < 0.05


def test_edges(spark, edges):
    labels = spark.createDataFrame(
        [(4, 1, 0), (6, 0, 1), (6, 0, None), (None, 1, 1), (99, 1, 1), (5, 1, 0)], LABELS
    )
    rows = toxicity.classify(edges, labels).collect()
    assert len(rows) == len(EDGES)
    assert all(r["score"] is not None for r in rows)


def test_without_labels_or_rows(spark, docs_of, edges):
    none = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in toxicity.classify(edges, none).collect()} == {0}
    assert toxicity.classify(docs_of([]), none).count() == 0
