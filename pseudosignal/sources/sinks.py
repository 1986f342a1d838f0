"""Where results are written: signal tables, quarantine, shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudosignal.schema import SIGNAL_SCHEMA
from pseudosignal.sources.files import remove

RUN = "run_id"


def with_bucket_date(signals: DataFrame, period: str = "day") -> DataFrame:
    """``bucket_date``: the day of the bucket, or the first day of its month or year."""
    day = F.substring("timestamp", 1, 10).try_cast("date")
    if period not in ("day", "month", "year"):
        raise ValueError("a table is partitioned by day, month or year")
    return signals.withColumn("bucket_date", day if period == "day" else F.trunc(day, period))


def write_signals(
    signals: DataFrame,
    path: str,
    mode: str = "append",
    run: str | None = None,
    period: str = "day",
) -> None:
    """Signal table partitioned by institution and day of the bucket.

    Where a day holds few signals, ``period`` makes that the first day of a month or year.

    The rebalance hint lets adaptive execution split an institution-day that holds
    much of the data and merge the many that hold little, so neither one giant
    writer nor a flood of small files results.

    With a ``run``, a job may be repeated: the name is one more partition, a run overwrites
    only the institution-days it wrote itself, and those that it no longer has are
    removed. Each institution-day is replaced when the job commits, so a repetition that fails
    before leaves the old rows. Without a run, repeating an append adds the rows again. A table
    is written with runs or without, not both.
    """
    dated = with_bucket_date(signals, period).hint("rebalance", "institution_id", "bucket_date")
    if run is None:
        dated.write.mode(mode).partitionBy("institution_id", "bucket_date").parquet(path)
        return
    if not run or run != run.strip() or any(c in run for c in "/\\:%="):
        raise ValueError("a run needs a name that can be a folder's")
    spark, place = signals.sparkSession, f"{path.rstrip('/')}/{RUN}={run}"
    before = _files(spark, place)
    (
        dated.withColumn(RUN, F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(RUN, "institution_id", "bucket_date")
        .parquet(path)
    )
    # An overwritten institution-day has new files only; one with old files was not written.
    remove(spark, *{file.rsplit("/", 1)[0] for file in before & _files(spark, place)})


def _files(spark: SparkSession, path: str) -> set[str]:
    """Parquet files below a folder, listed by Spark's tasks where there are many."""
    try:
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(path)
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    return {row["path"] for row in found.select("path").collect()}


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """A signal table as ``write_signals`` or the stream's sink wrote it: the columns of a signal
    and ``bucket_date``. The schema is given, so identifiers stay text as they were."""
    schema = T.StructType([*SIGNAL_SCHEMA.fields, T.StructField("bucket_date", T.DateType())])
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def write_wire_text(payloads: DataFrame, path: str, mode: str = "append") -> None:
    """Wire records as text, one JSON document per line."""
    payloads.select("payload").write.mode(mode).text(path)


def write_rejects(rejects: DataFrame, path: str, mode: str = "append") -> None:
    """Quarantine table."""
    rejects.write.mode(mode).parquet(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name that every executor can reach.

    It lies in ``spark.checkpoint.dir`` where the cluster sets one. Only a local
    session, whose executors share the machine, falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="pseudosignal-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder once and read back: cuts lineage like a checkpoint, but
    runs the plan once and is columnar, so later filters reach the scan."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's checkpoint folder.

    A folder of our own is set only where the session has none.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
