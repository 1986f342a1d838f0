"""Near-duplicate vectors by HNSW graphs, one for each shard of a label.

Vectors of a label are dealt by hash over shards of bounded size, and every shard gets a
graph. Every vector then queries every shard of its label, in blocks. A graph's beam is
widened until an audit against brute force, on some of its own vectors, passes. What the
graph returns is verified by cosine in double precision.

Identical vectors become one class first. A task returns, for each vector, how many it is
linked with, and of the links themselves only a spanning forest: groups of near copies
never expand into pairs between tasks.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.llm.common import components, stored, table
from pseudosignal.llm.hnsw import Graph

COSINE = 0.93
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
FIRST_BEAM = 24
# An audit compares so many vectors of a shard with brute force.
AUDITED, LEAST_RECALL = 64, 0.995


def usable(vector: Column) -> Column:
    """Not NULL, not empty, only finite components, not zero."""
    number = vector.cast("array<double>")
    bad = F.exists(
        number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.coalesce(
        vector.isNotNull() & ~bad & F.exists(number, lambda x: x != 0), F.lit(False)
    )


def unit_rows(vectors) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares stay finite."""
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _passing_beam(graph: Graph, cosine: float) -> int:
    """The first beam whose links of audited vectors agree with brute force."""
    n = len(graph.vectors)
    audited = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(int))
    width = FIRST_BEAM
    want = [set(np.flatnonzero(graph.vectors @ graph.vectors[i] >= cosine)) for i in audited]
    while width < n:
        hits = 0
        for i, truth in zip(audited.tolist(), want, strict=True):
            # From the graph's entry, as queries from other shards come in.
            hits += len(truth & set(graph.within(graph.vectors[i], cosine, width).tolist()))
        if hits >= LEAST_RECALL * sum(map(len, want)):
            break
        width *= 2
    return width


def _saved(arrays: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build(cosine: float):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        vectors = unit_rows(rows["embedding"])
        graph = Graph(vectors)
        arrays = graph.arrays() | {
            "rep": rows["rep"].to_numpy(np.int64),
            "copies": rows["copies"].to_numpy(np.int64),
        }
        first = rows.iloc[0]
        return pd.DataFrame(
            {
                "label": [first["label"]],
                "size": [first["size"]],
                "shard": [first["shard"]],
                "beam": [_passing_beam(graph, cosine)],
                "graph": [_saved(arrays)],
            }
        )

    return build


class _Forest:
    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        parent = self.parent
        up = parent[nodes]
        while True:
            next_up = parent[up]
            if (next_up == up).all():
                parent[nodes] = up
                return up
            up = next_up


def _search(cosine: float):
    def search(key: tuple, graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """(a, links, NULL): links of a here. (a, NULL, b): a link of the spanning forest."""
        none = pd.DataFrame({"a": [], "links": [], "b": []}).astype("Int64")
        if not len(graphs) or not len(queries):
            return none
        with np.load(io.BytesIO(graphs["graph"].iloc[0])) as file:
            saved = {name: file[name] for name in file.files}
        graph, width = Graph.of_arrays(saved), int(graphs["beam"].iloc[0])
        reps, copies = saved["rep"], saved["copies"]
        ids = queries["rep"].to_numpy(np.int64)
        vectors = unit_rows(queries["embedding"])
        if vectors.shape[1] != graph.vectors.shape[1]:
            return none
        place = {rep: i for i, rep in enumerate(reps.tolist())}
        # Queries from other shards are nodes of the forest behind the shard's own.
        forest = _Forest(len(reps) + len(ids))
        links = np.zeros(len(ids), np.int64)
        a, b = [], []
        for q, (rep, vector) in enumerate(zip(ids.tolist(), vectors, strict=True)):
            own = place.get(rep)
            found = graph.within(vector, cosine, width, own)
            found = found[graph.vectors[found] @ vector >= cosine]
            found = found[reps[found] != rep]
            if not len(found):
                continue
            links[q] = copies[found].sum()
            node = len(reps) + q if own is None else own
            roots, first = np.unique(forest.roots(found), return_index=True)
            mine = forest.roots(np.array([node]))[0]
            for root, k in zip(roots.tolist(), first.tolist(), strict=True):
                if root != mine:
                    forest.parent[root] = mine
                    a.append(rep)
                    b.append(int(reps[found[k]]))
        counted = links > 0
        return pd.DataFrame(
            {
                "a": pd.array([*ids[counted].tolist(), *a], "Int64"),
                "links": pd.array([*links[counted].tolist(), *[None] * len(a)], "Int64"),
                "b": pd.array([*[None] * int(counted.sum()), *b], "Int64"),
            }
        )

    return search


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label);
    other columns are ignored.

    Only vectors of the same, non-NULL label and dimension link. Vectors that are NULL, empty
    or zero or hold NULL or non-finite components link with nothing: no links, and a
    component of their own. So do rows with NULL vec_id; their component is NULL and kept
    is false. Rows that repeat a vec_id count as vectors of their own. An empty table gives
    no rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint"),
        F.col("label").cast("bigint"),
        F.col("embedding").cast("array<double>"),
        usable(F.col("embedding")).alias("good"),
    ).withColumn("good", F.expr("good and label is not null and vec_id is not null"))
    # Zero and minus zero are one value to the grouping, and to the cosine.
    classes = stored(
        rows.where("good")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")),
        "vectors",
    ).withColumn("size", F.size("embedding"))
    labels = classes.groupBy("label", "size").agg(F.count("*").alias("n"))
    labels = labels.select(
        "label",
        "size",
        F.ceil(F.col("n") / shard_rows).cast("bigint").alias("shards"),
        F.ceil(F.col("n") / block_rows).cast("bigint").alias("blocks"),
    )
    dealt = classes.join(labels, ["label", "size"])
    shard = F.pmod(F.xxhash64("rep", F.lit("shard")), "shards")
    block = F.pmod(F.xxhash64("rep", F.lit("block")), "blocks")

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    graphs = stored(
        dealt.withColumn("shard", shard)
        .groupBy("label", "size", "shard")
        .applyInPandas(
            _build(cosine), "label bigint, size int, shard bigint, beam int, graph binary"
        ),
        "graphs",
    )
    index = graphs.join(labels, ["label", "size"]).withColumn("block", numbers("blocks"))
    queries = dealt.withColumn("block", block).withColumn("shard", numbers("shards"))
    key = ["label", "size", "shard", "block"]
    found = stored(
        index.select(*key, "beam", "graph")
        .groupBy(*key)
        .cogroup(queries.select(*key, "rep", "embedding").groupBy(*key))
        .applyInPandas(_search(cosine), "a bigint, links bigint, b bigint"),
        "vector-links",
    )
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    result = (
        classes.join(links, F.col("rep") == F.col("a"), "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "embedding",
            F.coalesce("component", "rep").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    linked = rows.where("good").join(result, ["label", "embedding"]).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id")
    )
    alone = rows.where("not good").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
