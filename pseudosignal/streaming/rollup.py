"""Windowed rollup of a signal stream, for consumers that want final windows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pseudosignal.functions.instants import bucket_instant
from pseudosignal.operators.metrics import rollup_columns
from pseudosignal.streaming.commits import Batch, last_states, read_committed, start_committed

DEFAULT_WATERMARK = "7 days"
DEFAULT_DELAY = timedelta(days=7)
WINDOW = timedelta(minutes=15)
OBSERVED = "windowed_rollup"

WINDOWS = "windows"
ASIDE = "aside"
ON_TIME, LATE, UNTIMED = "on_time", "late", "untimed"
WINDOW_KEYS = ("window_start", "location_zone", "amount_tier", "institution_id")
_MICRO = timedelta(microseconds=1)


def windowed_rollup(signals: DataFrame, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Rollup per tumbling 15-minute window with Spark's own watermark.

    Backlogged signals arrive with their original bucket, so the watermark has to
    cover the longest outage. What comes later still is not added to its window, and signals
    without a bucket are in no window; ``late_rows`` and ``untimed_rows`` show how many of late.
    Where no row may be lost, use ``start_windowed_rollup``, or the partial rollups of
    the ingest stream, which need no watermark.
    """
    timed = rollup_columns(signals).withColumn("_instant", bucket_instant(F.col("bucket")))
    counted = timed.observe(
        OBSERVED,
        F.count(F.lit(1)).alias("signals"),
        F.count_if(F.col("_instant").isNull()).alias("untimed"),
    )
    return (
        counted.withWatermark("_instant", watermark)
        .groupBy(
            F.window("_instant", "15 minutes"), "location_zone", "amount_tier", "institution_id"
        )
        .agg(
            F.count(F.lit(1)).alias("signals"),
            F.count_if(F.col("near")).alias("near_threshold_signals"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            "location_zone",
            "amount_tier",
            "institution_id",
            "signals",
            "near_threshold_signals",
        )
    )


def start_windowed_rollup(
    signals: DataFrame,
    out: str,
    checkpoint: str,
    delay: timedelta = DEFAULT_DELAY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Rollup of a signal stream by 15-minute window that becomes final, and loses nothing.

    The watermark is the newest bucket of the batches before, less ``delay``; it is part of the
    committed state, so it and the counts outlast any number of batches and restarts. Signals
    of a window that is final by then, and signals without a bucket, are set aside as whole
    rows before the rollup. All others add to their window, as a partial count of their batch.
    """

    def job(batch: Batch) -> dict:
        state = batch.state
        final = _final_before(state, delay)
        start = F.unix_micros(bucket_instant(F.col("timestamp")))
        fate = F.when(start.isNull(), F.lit(UNTIMED))
        if final is not None:
            fate = fate.when(start + WINDOW // _MICRO <= final, F.lit(LATE))
        held = batch.rows.withColumn("fate", fate.otherwise(F.lit(ON_TIME))).persist()
        try:
            aside = batch.save(ASIDE, held.where(F.col("fate") != ON_TIME))
            timed = rollup_columns(held.where(F.col("fate") == ON_TIME))
            windows = batch.save(
                WINDOWS,
                timed.withColumn("window_start", bucket_instant(F.col("bucket")))
                .groupBy(*WINDOW_KEYS)
                .agg(
                    F.count(F.lit(1)).alias("signals"),
                    F.count_if(F.col("near")).alias("near_threshold_signals"),
                ),
            )
        finally:
            held.unpersist()
        seen = windows.agg(
            F.coalesce(F.sum("signals"), F.lit(0)).alias(ON_TIME),
            F.unix_micros(F.max("window_start")).alias("newest"),
        ).first()
        put = aside.agg(
            F.count_if(F.col("fate") == LATE).alias(LATE),
            F.count_if(F.col("fate") == UNTIMED).alias(UNTIMED),
        ).first()
        known = [x for x in (state.get("newest"), seen["newest"]) if x is not None]
        return {
            "newest": max(known, default=None),
            "delay": delay // _MICRO,
            ON_TIME: state.get(ON_TIME, 0) + seen[ON_TIME],
            LATE: state.get(LATE, 0) + put[LATE],
            UNTIMED: state.get(UNTIMED, 0) + put[UNTIMED],
        }

    return start_committed(signals, out, checkpoint, job, trigger)


def _final_before(state: dict, delay: timedelta) -> int | None:
    """Windows that end by then, in microseconds, are final."""
    return None if state.get("newest") is None else state["newest"] - delay // _MICRO


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """The windows so far, with ``final`` where no signal can be added any more.

    If several queries write to ``out``, a window is final when it is so for all of them.
    """
    limits = [
        None if s["newest"] is None else s["newest"] - s["delay"]
        for s in last_states(spark, out).values()
    ]
    final = F.lit(False)
    if limits and None not in limits:
        final = F.unix_micros("window_start") + WINDOW // _MICRO <= min(limits)
    return (
        read_committed(spark, out, WINDOWS)
        .groupBy(*WINDOW_KEYS)
        .agg(
            F.sum("signals").alias("signals"),
            F.sum("near_threshold_signals").alias("near_threshold_signals"),
        )
        .withColumn("final", final)
    )


def read_aside(spark: SparkSession, out: str) -> DataFrame:
    """Signals that came too late for their window or have no bucket, with ``fate``."""
    return read_committed(spark, out, ASIDE)


def window_counts(spark: SparkSession, out: str) -> dict[str, int]:
    """Signals ``on_time``, ``late`` and ``untimed`` over all committed batches."""
    states = last_states(spark, out).values()
    return {name: sum(s[name] for s in states) for name in (ON_TIME, LATE, UNTIMED)}


def untimed_rows(query: StreamingQuery) -> int:
    """Signals without a bucket in a ``windowed_rollup``, over the progress reports that the query
    holds (``spark.sql.streaming.numRecentProgressUpdates`` of them)."""
    found = (progress.observedMetrics.get(OBSERVED) for progress in query.recentProgress)
    return sum(row["untimed"] for row in found if row is not None)


def late_rows(query: StreamingQuery) -> int:
    """Partial groups a ``windowed_rollup`` has dropped as too late, over the progress reports that
    the query holds (``spark.sql.streaming.numRecentProgressUpdates`` of them)."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
