from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from pseudosignal.llm import embedding_dedup, neighbours
from pseudosignal.llm.hnsw import Graph

TABLE = "vec_id bigint, embedding array<float>, label int, n bigint, part string, score double"
NAN, INF = float("nan"), float("inf")


def vectors(seed: int, n: int, groups: int, size: int) -> list:
    """Random directions, and groups of near copies of some of them."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 16))
    for g in range(groups):
        base[g * size : (g + 1) * size] = base[g * size] + 0.08 * r.normal(size=(size, 16))
    label = r.integers(0, 2, n)
    return [(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(base, label))]


ODD = [
    (1000, None, 1), (1001, [0.0] * 16, 1), (1002, [NAN] + [1.0] * 15, 1), (1003, [1.0] * 16, None),
    (1004, [None] + [1.0] * 15, 1), (1005, [INF] + [1.0] * 15, 1), (None, [1.0] * 16, 1),
    (1006, [1.0] * 16, 1), (1007, [2.0] * 16, 1), (1008, [1.0] * 16, 1), (1009, [1.0, 1.0], 1),
    (1010, [], 1), (1011, [1.0] * 16, 1), (1011, [1.0] * 16, 1),
]


@pytest.fixture(scope="module")
def table_of(spark):
    def build(rows):
        return spark.createDataFrame([(*r, 1, "p", 0.5) for r in rows], TABLE)

    return build


def good(v) -> bool:
    return bool(v) and None not in v and all(map(np.isfinite, v)) and any(v)


def brute_force(rows):
    usable = [(i, np.asarray(v, float), k) for i, v, k in rows if good(v) and i is not None and k is not None]
    links, low = Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, (i, v, k) in enumerate(usable):
        for j, w, m in usable[a + 1 :]:
            if k == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                # Rows that repeat an id are counted each.
                links[i] += 1
                links[j] += 1
                one, other = sorted((find(i), find(j)))
                low[other] = one
    return {i: find(i) for i, _, _ in rows if i is not None}, links


def test_near_duplicates_agree_with_all_pairs(table_of):
    rows = vectors(1, 400, 8, 30) + ODD
    want, links = brute_force(rows)
    # Several shards and blocks of a label.
    found = embedding_dedup.near_duplicates(table_of(rows), shard_rows=60, block_rows=50).collect()
    assert len(found) == len(rows)
    repeated = Counter(i for i, _, _ in rows)
    for r in found:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
            continue
        assert r["component_id"] == want[r["vec_id"]], r
        assert r["n_links"] * repeated[r["vec_id"]] == links[r["vec_id"]], r
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_near_duplicates_of_no_rows(table_of):
    assert embedding_dedup.near_duplicates(table_of([])).count() == 0
    assert embedding_dedup.near_duplicates(table_of(ODD[:3])).count() == 3


def test_graph_finds_what_is_near():
    r = np.random.default_rng(2)
    rows = r.normal(size=(600, 16))
    rows[:200] = rows[0] + 0.05 * r.normal(size=(200, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    graph = Graph(rows)
    again = Graph.of_arrays(graph.arrays())
    hits = total = 0
    for i in range(0, 600, 5):
        want = set(np.flatnonzero(rows @ rows[i] >= 0.93))
        found = set(graph.within(rows[i], 0.93, 24).tolist())
        assert found <= want and found == set(again.within(rows[i], 0.93, 24).tolist())
        hits, total = hits + len(found & want), total + len(want)
    assert hits >= 0.99 * total
    assert len(Graph(rows[:0]).within(rows[0], 0.9, 8)) == 0
    assert Graph(rows[:1]).within(rows[0], 0.9, 8).tolist() == [0]


def exact_nearest(rows, k):
    usable = sorted(
        ((i, np.asarray(v, float)) for i, v, _ in rows if i is not None and good(v) and len(v) == 16),
        key=lambda x: x[0],
    )
    out = {}
    for i, v in usable:
        if i % 20 == 0:
            near = sorted((-float((w * v).sum()), j) for j, w in usable if j != i)
            out[i] = near[:k]
    return out


def test_nearest_of_few_rows_is_exact(table_of):
    rows = vectors(3, 120, 2, 20) + ODD
    found: dict = {}
    for r in neighbours.nearest(table_of(rows), block_rows=40).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact_nearest(rows, 20)
    assert found.keys() == want.keys()
    for query, near in want.items():
        assert [r for r, _, _ in sorted(found[query])] == list(range(1, 21))
        assert [v for _, v, _ in sorted(found[query])] == [j for _, j in near]
        assert np.allclose([s for _, _, s in sorted(found[query])], [-s for s, _ in near], rtol=1e-12)


def test_nearest_with_few_candidates_or_none(table_of):
    few = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.0, 1.0], 1)]
    found = neighbours.nearest(table_of(few)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(table_of([])).count() == 0


def test_recall_of_routing(table_of, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    rows = vectors(4, 1000, 20, 20)
    want, found = exact_nearest(rows, 20), {}
    for r in neighbours.nearest(table_of(rows)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {j for _, j in near}) for q, near in want.items())
    assert hits >= 0.9 * 20 * len(want)


def test_parts_are_balanced_and_cut_few_edges():
    r = np.random.default_rng(5)
    centres = np.repeat(np.eye(8), 50, axis=0)
    graph = neighbours.neighbour_graph(centres + 0.1 * r.normal(size=(400, 8)), 10)
    part = neighbours.balanced_parts(graph, 4)
    assert np.bincount(part, minlength=4).max() <= 106
    assert (part[graph] == part[:, None]).mean() > 0.6


def test_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows * 3, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for query in (0, 20, 40):
        others = sorted((-float(np.dot(rows[query][1], v)), i) for i, v in rows if i != query)
        assert got[query] == [(n + 1, others[n // 3][1]) for n in range(6)]
    assert set(got) == {0, 20, 40}
