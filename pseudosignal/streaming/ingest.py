"""Streaming ingest: the batch pipeline on a stream, with outputs that appear batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pseudosignal.operators.keys import KeyRing
from pseudosignal.operators.metrics import ROLLUP_KEYS, signal_rollup
from pseudosignal.operators.signals import accepted, judge, outcomes_of, refused
from pseudosignal.sources.json_lines import decode_transactions
from pseudosignal.sources.sinks import with_bucket_date
from pseudosignal.streaming.commits import EVERY_MINUTE, Batch, read_committed, start_committed

SIGNALS = "signals"
QUARANTINE = "quarantine"
ROLLUP = "rollup"
COUNTERS = "counters"
OBSERVED = "ingest"


def start_ingest(
    transactions: DataFrame,
    ring: KeyRing,
    out: str,
    checkpoint: str,
    keep: tuple[str, ...] = (),
    rollup: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Pseudonymise a stream of transactions into a signal table and a quarantine table.

    The tables of a micro-batch appear together, when all are written; a batch that is repeated
    after a failure counts once (see ``commits``). Nothing is dropped as late, the job keeps no
    state. A query with a new checkpoint adds to the output: old input read anew counts again.

    ``rollup`` also writes each batch's own signal rollup; these add up, as do the counters
    (transactions, signals and rejects by institution) of the committed batches. The counts of
    valid and rejected transactions are observed metrics of the query progress as well.
    """
    outcomes = outcomes_of(judge(transactions, ring), keep).observe(
        OBSERVED,
        F.count(F.lit(1)).alias("transactions"),
        F.count(F.col("reject_field")).alias("rejected"),
    )

    def job(batch: Batch) -> None:
        # Several outputs, one decoding: the outcomes stay until all are written.
        held = batch.rows.persist()
        try:
            signals = accepted(held, keep)
            batch.save(SIGNALS, signals)
            batch.save(QUARANTINE, refused(held, keep))
            batch.save(COUNTERS, _counted(held))
            if rollup:
                batch.save(ROLLUP, signal_rollup(signals))
        finally:
            held.unpersist()

    return start_committed(outcomes, out, checkpoint, job, trigger)


def _counted(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("institution_id").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(F.col("reject_field").isNull()).alias("signals_processed"),
        F.count("reject_field").alias("rejected"),
    )


def start_line_ingest(
    lines: DataFrame, ring: KeyRing, out: str, checkpoint: str, **options
) -> StreamingQuery:
    """The same for a stream of JSON lines with an ``institution_id`` column."""
    return start_ingest(decode_transactions(lines), ring, out, checkpoint, **options)


def start_signal_sink(
    signals: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    period: str = "day",
) -> StreamingQuery:
    """Durable queue of signals: files count once they are in the sink's commit log.

    The partition columns are those of the batch sink, and ``read_signals`` reads both: Spark
    finds the log in the folder and opens only files that are in it, so files of a batch that
    was cut off do not count, and a restart with the same checkpoint neither loses nor
    repeats a row.
    """
    return (
        with_bucket_date(signals, period)
        .writeStream.format("parquet")
        .partitionBy("institution_id", "bucket_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_MINUTE))
        .start()
    )


def read_output(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table of the ingest stream, of all batches committed so far."""
    return read_committed(spark, out, table)


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    counts = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def read_rollup(spark: SparkSession, out: str) -> DataFrame:
    """The rollup so far: the sum of the partial counts of all batches.

    Late signals simply add to their bucket, however old it is.
    """
    return _summed(read_output(spark, out, ROLLUP), *ROLLUP_KEYS)


def read_counters(spark: SparkSession, out: str) -> DataFrame:
    """Counters by institution over all committed batches, of this and earlier runs."""
    return _summed(read_output(spark, out, COUNTERS), "institution_id")
