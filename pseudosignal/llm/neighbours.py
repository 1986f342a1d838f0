"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is built and cut into parts of equal size with
few edges between them. A classifier learns the parts of a vector's neighbours from the
vector. It assigns every row to its likeliest part and routes a query to as many likely
parts as a check on the sample shows to be needed. Candidates are ranked by exact inner
products. Parts are dealt over blocks of bounded size, so a part of any size is searched by
many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pseudosignal.llm.common import small_batches, stored, table
from pseudosignal.llm.embedding_dedup import usable

# Rows on which the graph, the parts and the classifier are fitted, at most.
SAMPLE_ROWS = 4096
# The number of parts: one for so many rows, within these bounds. It does not grow with large
# tables: every part that is probed returns k rows to a query.
PART_ROWS, MIN_PARTS, MAX_PARTS = 512, 1, 16
GRAPH_NEIGHBOURS = 16
SLACK = 1.05  # a part's size over the mean
ROUNDS, STEPS = 30, 300
# Recall that routing must reach on the sample.
SAMPLE_RECALL = 0.95
K = 20
BLOCK_ROWS = 16_384
QUERY_ROWS = 4096
QUERY_EVERY = 20


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner products to each row, nearest first."""
    k = min(k, len(vectors) - 1)
    out = np.empty((len(vectors), k), np.int64)
    for start in range(0, len(vectors), 512):
        near = vectors[start : start + 512] @ vectors.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        out[start : start + 512] = np.take_along_axis(top, order, axis=1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 6) -> np.ndarray:
    """Part of each node: label propagation in which a part takes no more than its share.

    Nodes start at hash-random parts of equal size. Each round, in random order, a node
    moves to the part of most of its neighbours that still has room.
    """
    n = len(graph)
    random = np.random.default_rng(seed)
    part = random.permutation(np.arange(n) % parts)
    room = np.full(parts, int(np.ceil(n / parts * SLACK))) - np.bincount(part, minlength=parts)
    # Links count in both directions.
    starts = np.repeat(np.arange(n), graph.shape[1])
    both = np.concatenate([starts, graph.ravel()]), np.concatenate([graph.ravel(), starts])
    order = np.argsort(both[0], kind="stable")
    around = np.split(both[1][order], np.searchsorted(both[0][order], np.arange(1, n)))
    for _ in range(ROUNDS):
        moved = 0
        for node in random.permutation(n).tolist():
            votes = np.bincount(part[around[node]], minlength=parts)
            votes = np.where((room > 0) | (np.arange(parts) == part[node]), votes, -1)
            best = int(np.argmax(votes))
            if votes[best] > votes[part[node]]:
                room[part[node]] += 1
                room[best] -= 1
                part[node] = best
                moved += 1
        if moved <= n // 200:
            break
    return part


class Router:
    """A softmax classifier: probability of each part for a vector."""

    def __init__(self, weights: np.ndarray, probes: int) -> None:
        self.weights, self.probes = weights, probes

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        """Parts of each vector, likeliest first."""
        scores = vectors @ self.weights[:-1] + self.weights[-1]
        return np.argsort(-scores, axis=1, kind="stable")


def _classifier(vectors: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights (with an intercept in the last row) that predict the parts of the neighbours."""
    inputs = np.hstack([vectors, np.ones((len(vectors), 1))])
    theta = np.zeros((inputs.shape[1], share.shape[1]))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        scores = inputs @ theta
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        scores /= scores.sum(axis=1, keepdims=True)
        gradient = inputs.T @ (scores - share) / len(inputs) + 1e-5 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta


def fit(sample: np.ndarray, rows: int, k: int = K) -> Router:
    """The router for a table of so many rows, from a sample of its vectors."""
    parts = int(np.clip(rows // PART_ROWS, MIN_PARTS, min(MAX_PARTS, max(1, len(sample) // 64))))
    if parts == 1:
        return Router(np.zeros((sample.shape[1] + 1, 1)), 1)
    graph = neighbour_graph(sample, GRAPH_NEIGHBOURS)
    part = balanced_parts(graph, parts)
    share = np.zeros((len(sample), parts))
    np.add.at(share, (np.repeat(np.arange(len(sample)), graph.shape[1]), part[graph].ravel()), 1.0)
    share[np.arange(len(sample)), part] += 1.0
    share /= share.sum(axis=1, keepdims=True)
    router = Router(_classifier(sample, share), parts)
    # Rank at which each of a query's nearest rows would be probed, for some of the sample.
    truth = neighbour_graph(sample, k)[::4]
    ranked = router.ranked(sample)
    place = np.argsort(ranked[::4], axis=1)
    needed = np.take_along_axis(place, ranked[:, 0][truth], axis=1).ravel()
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= SAMPLE_RECALL:
            break
    router.probes = probes
    return router


def _routed(batches: Iterator[pa.RecordBatch], router: Router) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = np.array(batch.column(1).to_pylist(), np.float64)
        ranked = router.ranked(vectors)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(ranked[:, 0].astype(np.int64)),
                pa.array(ranked.astype(np.int64).tolist(), pa.list_(pa.int64())),
            ],
            names=["vec_id", "v", "part", "ranked"],
        )


def _best(k: int):
    def best(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of one block to each query; equal scores by smaller vec_id."""
        out: list[pd.DataFrame] = []
        if len(index) and len(queries):
            index = index.sort_values("vec_id", kind="stable")
            ids, vectors = index["vec_id"].to_numpy(), np.stack(index["v"].to_numpy())
            others = np.stack(queries["v"].to_numpy())
            for start in range(0, len(queries), 256):
                some = others[start : start + 256]
                near = some @ vectors.T
                for i, query in enumerate(queries["vec_id"].iloc[start : start + 256].tolist()):
                    row = np.where(ids == query, -np.inf, near[i])
                    if len(ids) > k:
                        # A little more than k, because this product is rounded another way.
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        at = np.flatnonzero(row >= least - 1e-9 * (1 + abs(least)))
                    else:
                        at = np.arange(len(ids))
                    at = at[ids[at] != query]
                    exact = (vectors[at] * some[i]).sum(axis=1)
                    order = np.lexsort((ids[at], -exact))[:k]
                    out.append(
                        pd.DataFrame(
                            {"query_id": query, "vec_id": ids[at][order], "score": exact[order]}
                        )
                    )
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat(out, ignore_index=True)

    return best


def nearest(
    vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner products found for each
    row whose vec_id is divisible by ``every``, the row's own vec_id excepted.

    Needs vec_id and embedding; other columns are ignored. Vectors that are NULL, empty or
    zero or hold NULL or non-finite components take no part, nor do rows with NULL vec_id,
    nor vectors of another dimension than the most frequent one. Ties go to the smaller
    vec_id. Rows that repeat a vec_id are one query, with the smallest vector, but are
    candidates each. With fewer than k candidates a
    query has them all; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v")
    )
    sizes = good.groupBy(F.size("v").alias("size")).count()
    top = sizes.orderBy(F.desc("count"), "size").first()
    size, rows = (top["size"], top["count"]) if top else (1, 0)
    good = good.where(F.size("v") == size)
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    chosen = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20))
    sample = good.where(chosen < F.lit(share * (1 << 20))).orderBy("vec_id").limit(SAMPLE_ROWS)
    fitted = np.array(sample.toArrow()["v"].to_pylist(), np.float64).reshape(-1, size)
    router = fit(fitted, rows, k)

    routed = stored(
        good.mapInArrow(
            lambda batches: _routed(batches, router),
            "vec_id bigint, v array<double>, part bigint, ranked array<bigint>",
        ),
        "routed",
    )
    parts = routed.groupBy("part").agg(F.count("*").alias("n"))
    held = {r["part"]: r["n"] for r in parts.collect()}
    blocks = F.create_map(
        *[F.lit(x) for p, n in sorted(held.items()) for x in (p, -(-n // block_rows))]
    ) if held else F.lit(None).cast("map<bigint,bigint>")
    # Parts with rows only, and further ones until k others are sure to be there.
    filled = F.filter("ranked", lambda p: F.element_at(blocks, p).isNotNull())
    counts = F.create_map(*[F.lit(x) for p, n in sorted(held.items()) for x in (p, n)]) if held else blocks
    enough = F.aggregate(
        filled,
        F.struct(F.lit(0).cast("bigint").alias("rows"), F.lit(0).alias("parts")),
        lambda s, p: F.when(
            (s["parts"] >= router.probes) & (s["rows"] > k), s
        ).otherwise(
            F.struct(
                (s["rows"] + F.element_at(counts, p)).alias("rows"), (s["parts"] + 1).alias("parts")
            )
        ),
        lambda s: s["parts"],
    )
    queried = (
        routed.where(F.col("vec_id") % every == 0)
        .groupBy("vec_id")
        .agg(F.min(F.struct("v", "ranked")).alias("row"))
        .select("vec_id", "row.*")
    )
    asked = queried.select(
        "vec_id", "v", F.explode(F.slice(filled, F.lit(1), enough)).alias("part")
    )
    n_queries = max(1, -(-routed.where(F.col("vec_id") % every == 0).count() // QUERY_ROWS))
    queries = asked.select(
        "vec_id",
        "v",
        "part",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.element_at(blocks, F.col("part")) - 1)).alias(
            "block"
        ),
        F.pmod(F.xxhash64("vec_id", F.lit("queries")), F.lit(n_queries)).alias("chunk"),
    )
    index = routed.select(
        "vec_id",
        "v",
        "part",
        F.pmod(F.xxhash64("vec_id", "v"), F.element_at(blocks, F.col("part"))).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_queries - 1).cast("bigint"))).alias(
            "chunk"
        ),
    )
    key = ["part", "block", "chunk"]
    found = (
        index.groupBy(*key)
        .cogroup(queries.groupBy(*key))
        .applyInPandas(_best(k), "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to each twentieth."""
    return nearest(table(spark, sf_dir, "embeddings"))
