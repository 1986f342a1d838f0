"""The Merkle manifest against plain Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pseudosignal.llm.manifest import FANOUT, fold, manifest, numbered, proof_digest


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashed(*below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        start = at // FANOUT * FANOUT
        path.append(("".join(level[start:at]), "".join(level[at + 1 : start + FANOUT])))
        at //= FANOUT
    return path


def expected(rows):
    """Sorted (doc_id, lang, leaf, subroot, proof) and the root."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0], hashed(*map(field, row))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for group in order:
        leaves = sorted(groups[group], key=lambda leaf: (leaf[0] is not None, leaf[0] or 0, leaf[1]))
        trees.append((leaves, levels_of([digest for _, digest in leaves])))
    above = levels_of([levels[-1][0] for _, levels in trees]) if trees else [[None]]
    out = []
    for number, (group, (leaves, levels)) in enumerate(zip(order, trees)):
        for at, (doc_id, digest) in enumerate(leaves):
            path = path_of(levels, at) + path_of(above, number)
            out.append((doc_id, group, digest, levels[-1][0], hashed(*[a + b for a, b in path])))
    return sorted(out, key=str), above[-1][0]


def check(docs):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    want, root = expected([tuple(r) for r in docs.select(*columns).collect()])
    rows, top = manifest(docs)
    got = rows.select("doc_id", "lang", "leaf", "subroot", proof_digest(F.col("path")), fold(F.col("seen"), F.col("path"))).collect()
    assert top == root
    assert sorted((tuple(r[:5]) for r in got), key=str) == want
    assert {r[5] for r in got} <= {root}


def test_odd_rows(edges):
    check(edges)


@pytest.mark.parametrize("count", [1, 2, 8, 9, 64, 65, 530])
def test_every_size(docs_of, count):
    check(docs_of([(i * 7 % 1000, f"text {i}", ["de", "en", None][min(i % 5, 2)], "s") for i in range(count)]))


def test_many_languages(docs_of):
    check(docs_of([(i, "same", f"l{i % 75}", None) for i in range(160)]))


def test_most_rows_repeat(docs_of):
    check(docs_of([(1, "again", "en", "s")] * 70 + [(i, "x", "en", "s") for i in range(30)]))


def test_empty_table(docs_of):
    rows, root = manifest(docs_of([(1, "a")]).where("false"))
    assert (rows.count(), root) == (0, None)


def test_only_tampered_rows_fail(docs_of):
    docs = docs_of([(i, f"Text {i}") for i in range(40)])
    tampered = F.when(F.col("doc_id") % 4 == 0, F.lower("text")).otherwise(F.col("text"))
    rows, root = manifest(docs, tampered)
    bad = rows.where(fold(F.col("seen"), F.col("path")) != F.lit(root)).select("doc_id").collect()
    assert sorted(r[0] for r in bad) == list(range(0, 40, 4))


def test_one_group_is_numbered_over_ranges(spark):
    rows = spark.range(5000).selectExpr("'' as k", "id * 31 % 5000 as id")
    done = numbered(rows.repartition(7), ["id"])
    assert done.where("idx != id or size != 5000").count() == 0
