"""Vector codes against the plain method."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pseudosignal.llm import vector_codes as vc

SCHEMA = "vec_id bigint, label int, embedding array<double>, v string, code string, error string, size int"


def plain(rows, rounds=vc.ROUNDS):
    """(vec_id, label, code, error) and the last codebook, by measuring every distance."""
    kept = [
        (i, label, [math.floor(1024 * x) for x in e])
        for i, label, e in rows
        if e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    usable = [r for r in kept if r[0] is not None and r[2] and len(r[2]) % 4 == 0]
    if not usable:
        return [], None
    length = len(min(usable, key=lambda r: (r[0], r[2]))[2])
    seeds = {}
    for i, _, e in sorted((r for r in usable if len(r[2]) == length), key=lambda r: (r[0], r[2])):
        seeds.setdefault(i, e)
    width = length // 4
    first = [seeds[i] for i in sorted(seeds)[:256]]
    books = [[tuple(e[p * width : (p + 1) * width]) for e in first] for p in range(4)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(books[p]))

    def assigned():
        return [[nearest(p, e[p * width : (p + 1) * width]) for p in range(4)] for e in coded]

    coded = [e for _, _, e in kept if len(e) == length]
    for _ in range(rounds):
        codes = assigned()
        for p in range(4):
            for j in range(len(books[p])):
                mine = [e[p * width : (p + 1) * width] for e, c in zip(coded, codes) if c[p][1] == j]
                if mine:
                    books[p][j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    codes, out = iter(assigned()), []
    for i, label, e in kept:
        if len(e) == length:
            own = next(codes)
            out.append((i, label, "".join(f"{j:02x}" for _, j in own), sum(d for d, _ in own)))
        else:
            out.append((i, label, None, None))
    return sorted(out, key=str), books


def table(spark, rows):
    return spark.createDataFrame([(*r, "v", "c", "e", 1) for r in rows], SCHEMA)


def vectors(count, seed=0, spread=0.2, width=8):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(12)]
    return [(i, i % 3, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(count)]


def check(spark, rows):
    want, books = plain(rows)
    coded, history, shares = vc.compress(table(spark, rows))
    assert sorted((tuple(r) for r in coded.collect()), key=str) == want
    if books is None:
        assert history == []
    else:
        assert history[-1].tolist() == [[list(c) for c in book] for book in books]
    return shares


def test_codes_are_those_of_the_plain_method(spark):
    shares = check(spark, vectors(700))
    assert shares[0] > 1 and shares[-1] < 0.5


def test_odd_rows(spark):
    rows = vectors(300, 1) + [
        (300, None, None),
        (301, 1, [1.0, None] * 4),
        (302, 1, [float("nan")] * 8),
        (303, 1, [float("inf")] * 8),
        (304, None, [0.0] * 8),
        (None, 1, [0.5] * 8),
        (305, 1, []),
        (306, 1, [1.0] * 7),
        (307, 1, [1.0] * 12),
        (5, 2, [0.25] * 8),
        (5, 2, [0.25] * 8),
        (308, 2, [60_000.0, -60_000.0] * 4),
    ]
    check(spark, rows)


def test_ties_go_to_the_lower_index(spark):
    check(spark, [(i, 0, [float(i % 5), 0.0] * 4) for i in range(400)])


def test_fewer_vectors_than_entries(spark):
    check(spark, vectors(9, 2))
    check(spark, vectors(1, 3))


def test_empty_tables(spark):
    check(spark, [])
    coded = vc.with_label_errors(vc.compress(table(spark, [(1, 1, None)]))[0])
    assert coded.count() == 0 and "label_error" in coded.columns


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="no exact square"):
        vc.compress(table(spark, [(1, 1, [1e9] * 8)]))


@pytest.mark.parametrize("bound", [0, vc.MAX_BROADCAST_LABELS])
def test_label_errors(spark, monkeypatch, bound):
    monkeypatch.setattr(vc, "MAX_BROADCAST_LABELS", bound)
    rows = spark.createDataFrame([(i, [None, 1, 2][i % 3], i) for i in range(90)], "vec_id bigint, label int, error bigint")
    for r in vc.with_label_errors(rows).collect():
        assert r["label_error"] == sum(i for i in range(90) if i % 3 == r["vec_id"] % 3)


def test_net_displacement_is_tighter_than_drift():
    there = np.array([[[0], [9]]] * 4)
    away, back = there + 5, there + 1
    assert vc.moved_since([there, away, back], 0)[0].max() == pytest.approx(1)


def test_large_integers_are_exact():
    rng = np.random.default_rng(0)
    x, e = (rng.integers(-vc.LARGEST, vc.LARGEST, (5, 300)) for _ in range(2))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in e] for r in x]
    assert vc.distances(x, e).tolist() == want
