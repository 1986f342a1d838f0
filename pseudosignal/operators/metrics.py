"""Operational counters and gauges per institution, and the signal rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pseudosignal.operators.delivery import DEAD, DELIVERED, EXHAUSTED, PENDING, PERMANENT

COUNTERS = (
    "signals_processed",
    "signals_forwarded",
    "signals_dead_lettered",
    "spool_rejects",
    "forward_failures",
    "processing_time_ms_total",
)
ROLLUP_KEYS = ("bucket", "location_zone", "amount_tier", "institution_id")


def _totals(parts: list[DataFrame], mode: str) -> DataFrame:
    """Add up partial counter rows; counters a part lacks are zero."""
    zero = F.lit(0).cast("long")
    rows = None
    for part in parts:
        part = part.select(
            "institution_id",
            *[
                (F.col(c).cast("long") if c in part.columns else zero).alias(c)
                for c in COUNTERS
            ],
        )
        rows = part if rows is None else rows.unionByName(part)
    return (
        rows.groupBy("institution_id")
        .agg(*[F.sum(c).alias(c) for c in COUNTERS])
        .select("institution_id", F.lit(mode).alias("mode"), *COUNTERS)
    )


def queued_counters(state: DataFrame, admissions: DataFrame | None = None) -> DataFrame:
    """Counters of queued delivery.

    A signal counts as processed when it is queued. ``admissions`` adds the
    arrivals that were refused because the queue was full; these were never queued,
    so they count as nothing else.
    """
    if admissions is not None:
        refused = admissions.where(~F.col("admitted"))
        state = state.join(refused.select("signal_id"), "signal_id", "left_anti")
    queued = state.groupBy("institution_id").agg(
        F.count(F.lit(1)).alias("signals_processed"),
        F.count_if(F.col("state") == DELIVERED).alias("signals_forwarded"),
        F.count_if(F.col("state") == DEAD).alias("signals_dead_lettered"),
    )
    parts = [queued]
    if admissions is not None:
        rejects = F.count(F.lit(1)).alias("spool_rejects")
        parts.append(refused.groupBy("institution_id").agg(rejects))
    return _totals(parts, "queued")


def synchronous_counters(budget: DataFrame) -> DataFrame:
    """Counters of synchronous delivery: processed means delivered within the budget.

    Processing time is that of the delivered signals: their attempts and waits.
    """
    delivered = F.col("result") == DELIVERED
    time = F.coalesce(F.col("elapsed_ms"), F.lit(0)) + F.col("waited_ms")
    counted = budget.groupBy("institution_id").agg(
        F.count_if(delivered).alias("signals_processed"),
        F.count_if(delivered).alias("signals_forwarded"),
        F.count_if(F.col("result").isin(PERMANENT, EXHAUSTED)).alias("forward_failures"),
        F.sum(F.when(delivered, time).otherwise(F.lit(0))).alias("processing_time_ms_total"),
    )
    return _totals([counted], "synchronous")


def backlog_depth(state: DataFrame) -> DataFrame:
    """Gauge: pending signals per institution, zero where all are done."""
    return state.groupBy("institution_id").agg(
        F.count_if(F.col("state") == PENDING).alias("spool_depth")
    )


def rollup_columns(signals: DataFrame) -> DataFrame:
    """The four grouping columns of the rollup and the flag it counts."""
    return signals.select(
        F.col("timestamp").alias("bucket"),
        F.col("metadata.location_zone").alias("location_zone"),
        F.col("metadata.amount_tier").alias("amount_tier"),
        "institution_id",
        F.coalesce(F.col("metadata.is_near_threshold"), F.lit(False)).alias("near"),
    )


def signal_rollup(signals: DataFrame) -> DataFrame:
    """Signals and near-threshold signals per bucket, zone, tier and institution."""
    return (
        rollup_columns(signals)
        .groupBy(*ROLLUP_KEYS)
        .agg(
            F.count(F.lit(1)).alias("signals"),
            F.count_if(F.col("near")).alias("near_threshold_signals"),
        )
    )
