"""Fixity audit of two replicas of an archive with Merkle trees.

A record's digest covers its content; a leaf of the tree covers an offset range of a file,
an inner node the nodes below it, a file's root the file, and trees over hashed file names
lead to one root for the whole archive. The audit compares roots and descends only into
branches that differ, down to the records of differing ranges. Each level is a grouped
aggregate of the level below; nodes have a bounded number of children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pseudosignal.llm.common import stored, table

# Bytes of a leaf's offset range; a power of two children to a node.
RANGE_BYTES = 1 << 16
FAN_OUT = 16
# Records of a derived archive file, and bytes of a record besides its content.
FILE_RECORDS = 1000
HEADER_BYTES = 128


def content_digest(*columns: str) -> Column:
    """SHA-256 of columns as text, each led by its length; NULL differs from empty."""
    parts = [
        F.coalesce(
            F.concat(F.octet_length(F.col(c)).cast("string"), F.lit(":"), F.col(c)), F.lit("-")
        )
        for c in columns
    ]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def archive(pages: DataFrame) -> DataFrame:
    """Records of an archive: file, offset, page_id, url, html. Pages lie in files of about
    FILE_RECORDS by page_id, one after another; those without page_id are dealt by hash."""
    number = F.coalesce(
        F.floor(F.col("page_id") / FILE_RECORDS),
        -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 16)),
    )
    length = HEADER_BYTES + F.coalesce(F.octet_length("url"), F.lit(0)) + F.coalesce(
        F.octet_length("html"), F.lit(0)
    )
    before = (
        Window.partitionBy("file")
        .orderBy("page_id", "digest")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = pages.select(
        F.concat(F.lit("warc-"), number.cast("string")).alias("file"),
        F.col("page_id").cast("bigint"),
        content_digest("url", "html").alias("digest"),
        length.cast("bigint").alias("length"),
    )
    return laid.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _leaves(records: DataFrame) -> DataFrame:
    """(file, node, digest) of offset ranges. Equal records at one offset are told apart by count."""
    same = records.groupBy("file", "offset", "digest").agg(F.count("*").alias("n"))
    return (
        same.groupBy("file", F.expr(f"offset div {RANGE_BYTES}").alias("node"))
        .agg(F.array_sort(F.collect_list(F.struct("offset", "digest", "n"))).alias("each"))
        .select(
            "file",
            "node",
            F.sha2(
                F.array_join(
                    F.transform(
                        "each", lambda r: F.concat_ws(":", r["offset"], r["digest"], r["n"])
                    ),
                    ",",
                ).cast("binary"),
                256,
            ).alias("digest"),
        )
    )


def _above(nodes: DataFrame, by: list, order: str) -> DataFrame:
    """Digests of parents: of the children's names and digests in order."""
    return (
        nodes.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "digest"))).alias("each"))
        .withColumn(
            "digest",
            F.sha2(
                F.array_join(
                    F.transform("each", lambda c: F.concat_ws(":", c["o"], c["digest"])), ","
                ).cast("binary"),
                256,
            ),
        )
        .drop("each")
    )


class Tree:
    """Merkle tree of a replica. ``records`` has file, offset and digest. levels[0] are the leaves;
    the last of levels has one node for each file."""

    def __init__(self, records: DataFrame, height: int) -> None:
        self.records = records
        self.levels = [stored(_leaves(records), "fixity-leaves")]
        for _ in range(height):
            parent = F.expr(f"node div {FAN_OUT}").alias("parent")
            below = self.levels[-1].select("file", "node", "digest", parent)
            self.levels.append(
                _above(below, ["file", "parent"], "node").withColumnRenamed("parent", "node")
            )
        name = F.sha2(F.col("file").cast("binary"), 256)
        self.files = self.levels[-1].select("file", "digest", F.substring(name, 1, 4).alias("b4"))
        self.fours = _above(self.files, ["b4"], "file").withColumn("b2", F.substring("b4", 1, 2))
        self.twos = _above(self.fours, ["b2"], "b4")

    def root(self) -> str | None:
        """Digest of the whole archive; NULL for an empty one."""
        return _above(self.twos.withColumn("all", F.lit(0)), ["all"], "b2").agg(
            F.max("digest")
        ).first()[0]


def _differing(one: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Keys with another digest in the two, or without one in either."""
    a = one.select(*key, F.col("digest").alias("one"))
    b = other.select(*key, F.col("digest").alias("other"))
    return a.join(b, key, "full").where(~F.col("one").eqNullSafe(F.col("other"))).select(*key)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ between two replicas: (file, offset, status, primary_digest,
    replica_digest), status corrupt, missing (from the replica) or extra.

    Both have file, offset and digest of every record; other columns are ignored. Records
    with NULL file, offset or digest are compared as empty file, offset 0 and empty digest.
    Repeated records count: if only their number differs, they are corrupt. Several faults
    at one offset are one row, with the largest digest of either side. Equal or empty
    replicas give no rows.
    """
    sides = []
    for side in (primary, replica):
        sides.append(
            stored(
                side.select(
                    F.coalesce("file", F.lit("")).alias("file"),
                    F.coalesce(F.col("offset").cast("bigint"), F.lit(0)).alias("offset"),
                    F.coalesce("digest", F.lit("")).alias("digest"),
                ),
                "fixity-records",
            )
        )
    end = max((s.agg(F.max("offset")).first()[0] or 0) for s in sides)
    height, nodes = 0, end // RANGE_BYTES
    while nodes:
        height, nodes = height + 1, nodes // FAN_OUT
    one, other = (Tree(s, height) for s in sides)
    compared = "file string, offset bigint, status string, primary_digest string, replica_digest string"
    if one.root() == other.root():
        return primary.sparkSession.createDataFrame([], compared)

    twos = _differing(one.twos, other.twos, ["b2"])
    fours = _differing(*(t.fours.join(twos, "b2", "left_semi") for t in (one, other)), ["b4"])
    files = _differing(*(t.files.join(fours, "b4", "left_semi") for t in (one, other)), ["file"])
    open_nodes = files.withColumn("node", F.lit(0).cast("bigint"))
    for level in range(height - 1, -1, -1):
        parents = open_nodes.select("file", F.col("node").alias("parent"))
        sides = (
            t.levels[level]
            .withColumn("parent", F.expr(f"node div {FAN_OUT}"))
            .join(parents, ["file", "parent"], "left_semi")
            for t in (one, other)
        )
        open_nodes = stored(_differing(*sides, ["file", "node"]), "fixity-open")
    return _records(one.records, other.records, open_nodes)


def _records(one: DataFrame, other: DataFrame, ranges: DataFrame) -> DataFrame:
    def within(records: DataFrame, name: str) -> DataFrame:
        node = F.expr(f"offset div {RANGE_BYTES}")
        near = records.withColumn("node", node).join(ranges, ["file", "node"], "left_semi")
        return near.groupBy("file", "offset", "digest").agg(F.count("*").alias(name))

    both = within(one, "n1").join(within(other, "n2"), ["file", "offset", "digest"], "full")
    odd = both.where(~F.col("n1").eqNullSafe(F.col("n2")))
    # A digest on one side and another one on the other side of an offset are one corrupt record.
    sides = odd.groupBy("file", "offset").agg(
        F.max(F.when(F.col("n1").isNotNull(), F.col("digest"))).alias("primary_digest"),
        F.max(F.when(F.col("n2").isNotNull(), F.col("digest"))).alias("replica_digest"),
    )
    status = (
        F.when(F.col("replica_digest").isNull(), "missing")
        .when(F.col("primary_digest").isNull(), "extra")
        .otherwise("corrupt")
    )
    return sides.select("file", "offset", status.alias("status"), "primary_digest", "replica_digest")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults at known places, by page_id: a changed record, a lost one, one too
    many. The offsets are those of the original."""
    number = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 4)
    fault = F.conv(number, 16, 10).cast("int") % 100
    kept = records.withColumn("fault", F.coalesce(fault, F.lit(50))).where("fault != 1")
    changed = kept.withColumn(
        "digest",
        F.when(F.col("fault") == 0, F.sha2(F.col("digest").cast("binary"), 256)).otherwise(
            F.col("digest")
        ),
    )
    extra = kept.where("fault = 2").withColumn("offset", F.col("offset") + F.lit(1))
    return changed.unionByName(extra).select("file", "offset", "digest")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults found between the archive of all pages and a damaged replica of it."""
    records = stored(archive(table(spark, sf_dir, "pages")), "fixity-archive")
    return audit(records, damaged(records))
