"""Admission limit on a stream of arrivals: queue depths carried from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pseudosignal.operators.admission import admission_control
from pseudosignal.operators.delivery import MAX_DEPTH
from pseudosignal.operators.signals import default_institution
from pseudosignal.streaming.commits import (
    LAST_ONLY,
    Batch,
    read_committed,
    read_last,
    start_committed,
)
from pseudosignal.streaming.ingest import COUNTERS

VERDICTS = "verdicts"
DEPTH = f"depth{LAST_ONLY}"
LEFT = "left"


def start_admission(
    arrivals: DataFrame,
    out: str,
    checkpoint: str,
    initial_depth: DataFrame | None = None,
    max_depth: int = MAX_DEPTH,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Admit or refuse a stream of arrivals (signal_id, institution_id, seq, enqueued_at).

    Each micro-batch is judged like a table of arrivals, with the depth that the batch before
    left; its verdicts and the depth after it, one row for each institution, are committed
    together, so a repeated batch neither counts its arrivals twice nor judges them anew. Where
    arrivals come in order, all verdicts are those of one table of all arrivals.

    With a boolean column ``left``, rows where it is true are signals that leave the queue
    (delivered or dead): those of a micro-batch make room before its arrivals are judged.
    """

    def job(batch: Batch) -> None:
        spark = batch.rows.sparkSession
        rows = default_institution(batch.rows)
        gone = F.coalesce(F.col(LEFT), F.lit(False)) if LEFT in rows.columns else F.lit(False)
        depth = batch.previous(DEPTH)
        if depth is None:
            depth = initial_depth
        if depth is None:
            depth = spark.createDataFrame([], "institution_id string, spool_depth bigint")
        depth = default_institution(depth.select("institution_id", "spool_depth"))
        leaving = rows.where(gone).select("institution_id", F.lit(-1).alias("spool_depth"))
        depth = (
            depth.unionByName(leaving)
            .groupBy("institution_id")
            .agg(F.greatest(F.sum("spool_depth"), F.lit(0)).alias("spool_depth"))
        )
        coming = rows.where(~gone).drop(LEFT)
        verdicts = batch.save(VERDICTS, admission_control(coming, depth, max_depth))
        counts = verdicts.groupBy("institution_id").agg(
            F.count_if("admitted").alias("signals_processed"),
            F.count_if(~F.col("admitted")).alias("spool_rejects"),
        )
        counts = batch.save(COUNTERS, counts)
        entered = counts.select("institution_id", F.col("signals_processed").alias("spool_depth"))
        batch.save(
            DEPTH,
            depth.unionByName(entered)
            .groupBy("institution_id")
            .agg(F.sum("spool_depth").alias("spool_depth")),
        )

    return start_committed(arrivals, out, checkpoint, job, trigger)


def read_verdicts(spark: SparkSession, out: str) -> DataFrame:
    """The arrivals judged so far, with ``admitted`` and ``reject_reason``."""
    return read_committed(spark, out, VERDICTS)


def read_depth(spark: SparkSession, out: str) -> DataFrame:
    """The depth of each queue after the last committed batch."""
    return read_last(spark, out, DEPTH)
