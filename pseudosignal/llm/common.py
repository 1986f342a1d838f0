"""Helpers shared by the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.sources.sinks import shared_folder

# A word, here and in the contracts: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows per Arrow batch. Documents can be very long, so batches are small.
BATCH_ROWS = 200
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: few rows and bytes per Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(column: str = "doc_id"):
    """CRC-32 of the identifier written as text; NULL for a NULL identifier."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, as (node, component).

    ``edges`` has columns a and b, any comparable type without NULL. The component is
    the smallest node of it. Nodes without edges do not appear.

    Alternates "large star" and "small star" (Kiveris and others, 2014): in each step
    every node tells its neighbours the smallest one it knows. Both steps are a grouped
    minimum and a join back, so a node with very many neighbours is never gathered in
    one place. Every round is written to the shared folder.
    """
    pairs = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u != v")
        .distinct()
    )
    pairs = stored(pairs, "components")
    mark = _fingerprint(pairs)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        pairs = stored(_small_star(_large_star(pairs)), "components")
        before, mark = mark, _fingerprint(pairs)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _fingerprint(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    # Only larger neighbours move: u, then, is the smaller end of the pair.
    return (
        pairs.join(low.withColumnRenamed("u", "v"), "v")
        .select(F.col("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u != v").distinct()


# Bits of a membership map: 2 MiB, whatever the size of the data.
MAP_BITS = 1 << 24


def membership_map(ids: DataFrame, column: str, bits: int = MAP_BITS) -> bytes:
    """A one-hash Bloom filter of a column of longs. At most ``bits`` / 8 bytes reach the driver.

    It lets through everything that is in the column, and more the fuller it is; whoever
    uses it joins exactly afterwards. It only saves shuffling rows that cannot match.
    """
    import numpy as np

    at = F.pmod(F.xxhash64(column), F.lit(bits))
    words = (
        ids.select(at.alias("at"))
        .groupBy(F.shiftright("at", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("set"))
        .toArrow()
    )
    filled = np.zeros(bits // 32, dtype=np.uint32)
    filled[words["word"].to_numpy()] = words["set"].to_numpy().astype(np.uint32)
    return filled.tobytes()


def maybe_in(df: DataFrame, column: str, filled: bytes, keep: bool = True) -> DataFrame:
    """Rows whose ``column`` may be in the map, or, with keep=False, is surely not in it."""
    import numpy as np
    import pyarrow as pa

    bits = 8 * len(filled)
    probe = "_probe"
    while probe in df.columns:
        probe += "_"
    schema = df.schema
    shared = df.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        words = np.frombuffer(shared.value, dtype=np.uint32)
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            found = (words[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
            rest = batch.select(list(range(batch.num_columns - 1)))
            yield rest.filter(pa.array(found if keep else ~found))

    # A NULL hashes like any other value; callers decide about it beforehand.
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    return df.select("*", at.alias(probe)).mapInArrow(run, schema)


def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not in ``ids`` (one column of that name).

    Rows that are surely not in it go straight through; only the rest is shuffled for the
    exact anti-join. Rows with NULL stay.
    """
    filled = membership_map(ids, column)
    sure = maybe_in(df, column, filled, keep=False)
    rest = maybe_in(df, column, filled).join(ids, column, "left_anti").select(*df.columns)
    return sure.unionByName(rest)


@contextmanager
def bounded_batches(spark: SparkSession):
    """Small Arrow batches for the jobs that run inside; the session's own settings come back."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {name: spark.conf.get(name) for name in names}
    small_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Shuffle files of the jobs that run inside go when their job ends, not when the driver happens to
    collect its garbage; the session's own setting comes back. For jobs that store what they make."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Like ``stored``, and the folder, for ``discard`` once nothing reads it any more."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of intermediate results, in whatever store they lie."""
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
