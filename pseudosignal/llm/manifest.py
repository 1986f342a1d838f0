"""Merkle dataset manifest by slot pivots.

Every row is a leaf. Within a group (the language) leaves are numbered in order, and every run
of ``FANOUT`` consecutive nodes becomes its parent: one conditional aggregate for each slot
spreads the children into as many columns, and the parent is the digest of those columns in a
row. The roots of the groups are then the leaves of one more such tree. A proof goes the other
way: the pivoted columns without the own slot are the siblings, so each level takes the path of
its parent and adds one step.

No group is gathered or sorted in one task. Leaves are sorted into ranges over all groups at
once; a range counts its rows of each group, and the prefix sums of these few counts turn the
place in a range into the place in the group. Each level is a grouping by (group, parent) that
combines before the shuffle and is an eighth of the level below; levels are written to the
shared folder, and only numbers of levels and the root come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pseudosignal.llm.common import id_text, stored, table

# Children of a node.
FANOUT = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Documents whose checksum this divides are tampered with in the audit of the query.
TAMPER_EVERY = 3

PATH = "array<struct<left:string,right:string>>"
_SLOTS = [f"s{slot}" for slot in range(FANOUT)]


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else number of UTF-8 bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Digest of a documents row, with some columns replaced."""
    return digest(*[field(changed.get(name, F.col(name))) for name in LEAF_COLUMNS])


def group_key(lang: Column) -> Column:
    """A text that is never NULL and sorts NULL first, else bytewise."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (with a group ``k``) and their place ``idx`` in the group, from 0, and its ``size``.

    Rows equal in ``k`` and ``order`` may fall into several ranges: a random number, the same
    on every attempt of a task, deals them out.
    """
    names = rows.columns
    dealt = rows.withColumn("_salt", F.rand(0))
    keys = ["k", *order, "_salt"]
    placed = stored(
        dealt.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*names, F.monotonically_increasing_id().alias("_at")),
        "manifest-order",
    ).withColumn("_range", F.shiftright("_at", 33))
    counts = stored(
        placed.groupBy("k", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")),
        "manifest-counts",
    )
    whole = Window.partitionBy("k")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "k",
        "_range",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("size"),
    )
    return placed.join(bases, ["k", "_range"]).select(
        *names, (F.col("_at") + F.col("_shift")).alias("idx"), "size"
    )


@dataclass(frozen=True)
class Tree:
    """Trees of all groups. ``levels[i]`` has (k, idx, size, s0.., digest) for the parents of the
    nodes below, ``tops`` has (k, digest): what remains of each group."""

    levels: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame) -> Tree:
    """Trees over nodes (k, idx, size, digest); idx runs from 0 to size - 1 within k."""
    nodes = nodes.select("k", "idx", "size", "digest")
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels, tops = [], nodes.where("size = 1").select("k", "digest")
    while most > 1:
        slot = F.pmod(F.col("idx"), F.lit(FANOUT))
        level = (
            nodes.where("size > 1")
            .groupBy(
                "k",
                F.expr(f"idx div {FANOUT}").alias("parent"),
                F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("above"),
            )
            .agg(*[F.max(F.when(slot == i, F.col("digest"))).alias(s) for i, s in enumerate(_SLOTS)])
            .select(
                "k",
                F.col("parent").alias("idx"),
                F.col("above").alias("size"),
                *_SLOTS,
                F.sha2(F.concat_ws("", *_SLOTS), 256).alias("digest"),
            )
        )
        level = stored(level, "manifest-level")
        levels.append(level)
        nodes = level.select("k", "idx", "size", "digest")
        tops = tops.unionByName(nodes.where("size = 1").select("k", "digest"))
        most = -(-most // FANOUT)
    return Tree(levels, stored(tops, "manifest-tops"))


def _step() -> Column:
    """Siblings of the node ``idx`` in the pivoted columns of its parent, as (left, right)."""
    slot = F.pmod(F.col("idx"), F.lit(FANOUT))
    left = F.concat_ws("", *[F.when(slot > i, F.col(s)) for i, s in enumerate(_SLOTS)])
    right = F.concat_ws("", *[F.when(slot < i, F.col(s)) for i, s in enumerate(_SLOTS)])
    return F.struct(left.alias("left"), right.alias("right"))


def _down(nodes: DataFrame, above: DataFrame | None, starts: DataFrame) -> DataFrame:
    """Nodes (k, idx, size, ..) with their ``path``: that of the parent after the own step. The
    top of a group takes the path that ``starts`` (k, path) has for the group."""
    tops = nodes.where("size = 1").join(starts, "k")
    if above is None:
        return tops
    parents = above.select(
        "k", F.col("idx").alias("_parent"), *_SLOTS, F.col("path").alias("_above")
    )
    own = nodes.where("size > 1").withColumn("_parent", F.expr(f"idx div {FANOUT}"))
    # Nodes have the columns of their own children too; these are set aside meanwhile.
    names = nodes.columns
    own = own.select(F.struct(*names).alias("_node"), "k", "idx", "_parent")
    stepped = own.join(parents, ["k", "_parent"]).select(
        *[F.col(f"_node.`{c}`").alias(c) for c in names],
        F.concat(F.array(_step()), F.col("_above")).alias("path"),
    )
    return tops.select(*names, "path").unionByName(stepped)


def paths(tree: Tree, leaves: DataFrame, starts: DataFrame) -> DataFrame:
    """``leaves`` (k, idx, size, ..) with ``path``: (left, right) siblings from leaf to root."""
    above = None
    for level in reversed(tree.levels):
        above = _down(level, above, starts)
    return _down(leaves, above, starts)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda at, step: digest(step["left"], at, step["right"]))


def proof_digest(path: Column) -> Column:
    siblings = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return F.sha2(F.array_join(siblings, ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> tuple[DataFrame, str | None]:
    """One row for each document, and the root of all.

    Rows: doc_id, lang, leaf, subroot, path, seen; ``seen`` is the leaf of the document whose
    text is ``tampered``, an expression over ``docs``, or the leaf itself.

    Any column may be NULL; a NULL language is a group, the first one. Within a language leaves
    go by doc_id, NULL first, and those with equal ids by digest, so repeated rows are leaves of
    their own with equal digests. Empty and very long texts are values like others. Other
    columns are ignored whatever their names. A single row is its own root, with an empty path.
    An empty table gives no rows and the root None.
    """
    leaves = stored(
        docs.select(
            F.col("doc_id").alias("id"),
            group_key(F.col("lang")).alias("k"),
            leaf_digest().alias("digest"),
            (leaf_digest() if tampered is None else leaf_digest(text=tampered)).alias("seen"),
        ),
        "manifest-leaves",
    )
    # NULL ids come first, as they do in an ascending order anyway.
    leaves = stored(numbered(leaves, ["id", "digest"]), "manifest-numbered")
    tree = build(leaves)
    groups = tree.tops.select(F.lit("").alias("k"), F.col("k").alias("group"), "digest")
    groups = stored(numbered(groups, ["group"]), "manifest-groups")
    upper = build(groups)
    top = upper.tops.first()
    starts = upper.tops.select("k", F.from_json(F.lit("[]"), PATH).alias("path"))
    group_paths = stored(
        paths(upper, groups, starts).select(
            F.col("group").alias("k"), "path", F.col("digest").alias("subroot")
        ),
        "manifest-group-paths",
    )
    found = paths(tree, leaves, group_paths.select("k", "path"))
    rows = found.join(group_paths.select("k", "subroot"), "k").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).alias("lang"),
        F.col("digest").alias("leaf"),
        "subroot",
        "path",
        "seen",
    )
    return rows, None if top is None else top["digest"]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def op13_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and an audit of all documents, a third of them with their text lower-cased.

    Contract and cases as in ``manifest``; a document without id is not tampered with.
    """
    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.pmod(id_text(), F.lit(TAMPER_EVERY)) == 0, F.lit(False))
    tampered = F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rows, root = manifest(docs, tampered)
    top = F.lit(root).cast("string")
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "leaf",
        "subroot",
        top.alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.col("seen"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == top)
