"""The named queries: every operator on the transactions derived from the test tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudosignal.functions import amount_tier, location_zone, time_bucket
from pseudosignal.functions.instants import utc_text
from pseudosignal.operators import admission, audit, delivery, matching, metrics
from pseudosignal.operators import signals as ps
from pseudosignal.operators import validate as va
from pseudosignal.plans import sample_tables as sample
from pseudosignal.schema import RAW_FIELDS
from pseudosignal.session import tune
from pseudosignal.sources import (
    conform,
    decode_transactions,
    read_lines,
    read_signals,
    shared_folder,
    write_signals,
)
from pseudosignal.sources.files import files_of, size_of
from pseudosignal.sources.sinks import checkpointed
from pseudosignal.streaming import admission as admitting
from pseudosignal.streaming import ingest as stream
from pseudosignal.streaming import rollup as windows

Query = Callable[[SparkSession, str], DataFrame]

KEY = ("tx_id",)
MAX_DEPTH = 500
NOW = {"availableNow": True}
# Bytes below which the rows of a micro-batch are not dealt over several files.
LEAST_FILE = 1 << 20


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(sample.raw_tx(tune(spark), sf_dir))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.validate_transactions(_raw(spark, sf_dir))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_transactions(sample.transaction_lines(_raw(spark, sf_dir)))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ps.judge(_raw(spark, sf_dir), sample.sample_ring(spark))
    return ps.signals_of(judged, KEY)


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.outbox(_signals(spark, sf_dir), ps.wire_json())


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.attempts(_raw(spark, sf_dir))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivery_state(_outbox(spark, sf_dir), _attempts(spark, sf_dir))


def _instant_text(name: str):
    return utc_text(F.unix_seconds(F.col(name))).alias(name)


def _with_texts(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[_instant_text(c) if c in names else F.col(c) for c in df.columns])


# --- sources ---------------------------------------------------------------------


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir)


def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as text files by institution, read and decoded."""
    folder = shared_folder(spark, "lines")
    lines = sample.transaction_lines(_raw(spark, sf_dir)).select("value", "institution_id")
    lines.write.partitionBy("institution_id").text(folder)
    return decode_transactions(read_lines(spark, folder))


def decode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir)


def reject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.reject_summary(va.validate_transactions(_decoded(spark, sf_dir)))


# --- validation --------------------------------------------------------------------


def validate_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select(
        "tx_id", "institution_id", "reject_field", "reject_reason"
    )


def valid_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.valid_transactions(_validated(spark, sf_dir)).select(
        "tx_id", "institution_id", *RAW_FIELDS
    )


def rejected_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.rejected_transactions(_validated(spark, sf_dir))


# --- projections -------------------------------------------------------------------


def normalised_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.normalised_identities(_raw(spark, sf_dir))


def identity_mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.identity_mosaics(_raw(spark, sf_dir), sample.sample_ring(spark))


def destination_mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.destination_mosaics(_raw(spark, sf_dir), sample.sample_ring(spark))


def salted_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.salted_hashes(_raw(spark, sf_dir), sample.sample_ring(spark))


def amount_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select(
        "tx_id", "amount", amount_tier(F.col("amount")).alias("amount_tier")
    )


def near_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.near_threshold_flags(
        _raw(spark, sf_dir), sample.sample_ring(spark), ("tx_id", "amount")
    )


def location_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select(
        "tx_id", location_zone(F.col("latitude"), F.col("longitude")).alias("location_zone")
    )


def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select(
        "tx_id", "timestamp", time_bucket(F.col("timestamp")).alias("time_bucket")
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.flat(_signals(spark, sf_dir))


def wire_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.payloads(_signals(spark, sf_dir), KEY)


def signed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = ps.payloads(_signals(spark, sf_dir), KEY)
    return ps.sign_payloads(records, sample.sample_ring(spark))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.receipts(_signals(spark, sf_dir))


def pii_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pii_leak_audit(_raw(spark, sf_dir), _signals(spark, sf_dir))


# --- delivery ----------------------------------------------------------------------


def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.delivery_outcomes(_attempts(spark, sf_dir)).select(
        "signal_id", "attempt_no", "status_code", "outcome"
    )


def delivery_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_texts(_state(spark, sf_dir), "enqueued_at", "last_attempt_at")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.dead_letters(_outbox(spark, sf_dir), _attempts(spark, sf_dir))


def pending_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    backlog = delivery.pending_backlog(_outbox(spark, sf_dir), _attempts(spark, sf_dir))
    return _with_texts(backlog, "enqueued_at")


def queue_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_texts(
        delivery.queue_heads(_state(spark, sf_dir)), "enqueued_at", "last_attempt_at"
    )


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_texts(delivery.retry_schedule(_state(spark, sf_dir)), "next_attempt_at")


def retry_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.retry_budget(_attempts(spark, sf_dir))


def _admissions(state: DataFrame) -> DataFrame:
    """Signals tried before are the queue, those never tried arrive now."""
    tried = F.col("attempts") > 0
    return admission.admission_control(
        state.where(~tried).select("signal_id", "institution_id", "seq", "enqueued_at"),
        metrics.backlog_depth(state.where(tried)),
        MAX_DEPTH,
    )


def admission_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Admission reads its input several times, so it gets a stored table.
    return _admissions(checkpointed(_state(spark, sf_dir))).select(
        "signal_id", "institution_id", "admitted", "reject_reason"
    )


# --- metrics -----------------------------------------------------------------------


def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = checkpointed(_state(spark, sf_dir))
    queued = metrics.queued_counters(state, _admissions(state))
    budget = delivery.retry_budget(_attempts(spark, sf_dir))
    return queued.unionByName(metrics.synchronous_counters(budget))


def backlog_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.backlog_depth(_state(spark, sf_dir))


def signal_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.signal_rollup(_signals(spark, sf_dir))


# --- matching ----------------------------------------------------------------------


def cross_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.cross_institution(_signals(spark, sf_dir))


def within_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.within_institution(_signals(spark, sf_dir))


def route_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.route_links(_signals(spark, sf_dir))


def shared_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.shared_fingerprints(_signals(spark, sf_dir))


def version_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth signal is made one of the first generation, without version and scope."""
    first = F.col("tx_id") % 10 == 0
    mixed = _signals(spark, sf_dir).withColumns(
        {
            "mosaic_version": F.when(~first, F.col("mosaic_version")),
            "mosaic_scope": F.when(~first, F.col("mosaic_scope")),
        }
    )
    return matching.version_partition(mixed)


# --- streaming ---------------------------------------------------------------------


def _run_stream(spark: SparkSession, sf_dir: str) -> str:
    """Stream the orders as JSON lines through the ingest job; the folder of its output."""
    orders = (
        tune(spark)
        .readStream.schema(sample.table(spark, sf_dir, "orders").schema)
        .option("pathGlobFilter", "orders.parquet")
        .parquet(sf_dir)
    )
    raw = conform(sample.raw_transactions(orders, sample.table(spark, sf_dir, "customer")))
    out = shared_folder(spark, "ingest")
    query = stream.start_line_ingest(
        sample.transaction_lines(raw),
        sample.sample_ring(spark),
        out,
        f"{out}/checkpoint",
        keep=KEY,
        rollup=True,
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    return out


def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.flat(stream.read_output(spark, _run_stream(spark, sf_dir), stream.SIGNALS))


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.read_output(spark, _run_stream(spark, sf_dir), stream.QUARANTINE)


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.read_rollup(spark, _run_stream(spark, sf_dir))


def _file_stream(
    spark: SparkSession, rows: DataFrame, batch: Column, order: Sequence[int], purpose: str
) -> DataFrame:
    """The rows as a stream of files, those of one value of ``batch`` after the other, in ``order``.

    Every value is as many files as any other, and these are one micro-batch. There are as many
    as tasks read its rows, but none for less than a MiB, so large values are written and read by
    all cores. A value with fewer files is filled up with empty ones.
    """
    staged, folder = shared_folder(spark, f"{purpose}-rows"), shared_folder(spark, purpose)
    rows.withColumn("batch", batch.cast("int")).write.partitionBy("batch").parquet(staged)
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    table = spark.read.schema(schema).parquet(staged)
    parts = [table.where(F.col("batch") == n).drop("batch") for n in order]
    largest = max(size_of(spark, f"{staged}/batch={n}") for n in order)
    tasks = max(part.rdd.getNumPartitions() for part in parts)
    files = max(1, min(tasks, math.ceil(largest / LEAST_FILE)))
    for number, part in enumerate(parts, 1):
        part.coalesce(files).write.mode("append").parquet(folder)
        for _ in range(number * files - len(files_of(spark, folder, ".parquet"))):
            spark.createDataFrame([], part.schema).write.mode("append").parquet(folder)
    stream_of = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files)
    return stream_of.parquet(folder)


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an ingest stream that was stopped after a batch and started again."""
    lines = sample.transaction_lines(_raw(spark, sf_dir))
    source = _file_stream(spark, lines, F.pmod("tx_id", F.lit(4)), range(4), "counted-in")
    out = shared_folder(spark, "counted")
    places = (source, sample.sample_ring(spark), out, f"{out}/checkpoint")
    first = stream.start_line_ingest(*places, trigger={"processingTime": "0 seconds"})
    while first.isActive and not first.recentProgress:
        first.awaitTermination(1)
    first.stop()
    stream.start_line_ingest(*places, trigger=NOW).awaitTermination()
    return stream.read_counters(spark, out)


def _with_day_text(table: DataFrame) -> DataFrame:
    return table.withColumn("bucket_date", F.col("bucket_date").cast("string"))


def signal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written by two runs, one of which first wrote other rows and was repeated."""
    path = shared_folder(spark, "signals")
    code = F.when(F.col("institution_id") == "BNK_0", "007").otherwise(F.col("institution_id"))
    signals = checkpointed(_signals(spark, sf_dir).withColumn("institution_id", code))
    even = F.col("tx_id") % 2 == 0
    wrong = signals.where(~even).withColumn("timestamp", F.lit("1999-01-01T00:00:00Z"))
    write_signals(wrong, path, run="odd", period="year")
    write_signals(signals.where(even), path, run="even", period="year")
    write_signals(signals.where(~even), path, run="odd", period="year")
    return _with_day_text(ps.flat(read_signals(spark, path)))


def signal_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The durable sink, stopped after its first batches and started again."""
    signals = _signals(spark, sf_dir).drop("tx_id")
    place = F.pmod(F.xxhash64("identity_mosaic", "timestamp"), F.lit(4))
    source = _file_stream(spark, signals, place, range(4), "sink-in")
    path = shared_folder(spark, "sink")
    places = (source, path, f"{path}-checkpoint")
    first = stream.start_signal_sink(*places, {"processingTime": "0 seconds"}, "year")
    while first.isActive and not first.recentProgress:
        first.awaitTermination(1)
    first.stop()
    stream.start_signal_sink(*places, NOW, "year").awaitTermination()
    return _with_day_text(ps.flat(read_signals(spark, path)))


def stream_windowed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a stream out of order, and what came too late for them, added up."""
    signals = _signals(spark, sf_dir).drop("tx_id")
    place = F.pmod(F.xxhash64("identity_mosaic", "timestamp"), F.lit(4))
    source = _file_stream(spark, signals, place, range(4), "windows-in")
    out = shared_folder(spark, "windows")
    windows.start_windowed_rollup(
        source, out, f"{out}-checkpoint", delay=timedelta(days=365), trigger=NOW
    ).awaitTermination()
    bucket = utc_text(F.unix_seconds("window_start")).alias("bucket")
    timed = windows.read_windows(spark, out).withColumn("bucket", bucket)
    late = metrics.signal_rollup(windows.read_aside(spark, out))
    return (
        timed.select(*late.columns)
        .unionByName(late)
        .groupBy(*metrics.ROLLUP_KEYS)
        .agg(
            F.sum("signals").alias("signals"),
            F.sum("near_threshold_signals").alias("near_threshold_signals"),
        )
    )


def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals in three batches, judged with the depth that the batch before left."""
    state = checkpointed(_state(spark, sf_dir))
    arrivals = state.where("attempts = 0").select(
        "signal_id", "institution_id", "seq", "enqueued_at"
    )
    third = F.expr("pmod(unix_seconds(enqueued_at), 3000) div 1000")
    out = shared_folder(spark, "admission")
    admitting.start_admission(
        _file_stream(spark, arrivals, third, (2, 0, 1), "arrivals"),
        out,
        f"{out}-checkpoint",
        metrics.backlog_depth(state.where("attempts > 0")),
        MAX_DEPTH,
        NOW,
    ).awaitTermination()
    return admitting.read_verdicts(spark, out).select(
        "signal_id", "institution_id", "admitted", "reject_reason"
    )


QUERIES: dict[str, Query] = {
    "raw_transactions": raw_transactions,
    "decode_transactions": decode_lines,
    "reject_summary": reject_summary,
    "validate_transactions": validate_transactions,
    "valid_transactions": valid_transactions,
    "rejected_transactions": rejected_transactions,
    "normalised_identities": normalised_identities,
    "identity_mosaics": identity_mosaics,
    "destination_mosaics": destination_mosaics,
    "salted_hashes": salted_hashes,
    "read_json_lines": read_json_lines,
    "amount_tiers": amount_tiers,
    "near_threshold": near_threshold,
    "location_zones": location_zones,
    "time_buckets": time_buckets,
    "signals": signals,
    "wire_json": wire_json,
    "signed_payloads": signed_payloads,
    "receipts": receipts,
    "pii_leak_audit": pii_leak_audit,
    "delivery_outcomes": delivery_outcomes,
    "delivery_state": delivery_state,
    "dead_letters": dead_letters,
    "pending_backlog": pending_backlog,
    "queue_heads": queue_heads,
    "retry_schedule": retry_schedule,
    "retry_budget": retry_budget,
    "admission_control": admission_control,
    "metrics_counters": metrics_counters,
    "backlog_depth": backlog_depth,
    "signal_rollup": signal_rollup,
    "cross_institution": cross_institution,
    "within_institution": within_institution,
    "route_links": route_links,
    "shared_fingerprints": shared_fingerprints,
    "version_partition": version_partition,
    "stream_signals": stream_signals,
    "stream_rejects": stream_rejects,
    "stream_rollup": stream_rollup,
    "stream_counters": stream_counters,
    "stream_windowed_rollup": stream_windowed_rollup,
    "stream_admission": stream_admission,
    "signal_table": signal_table,
    "signal_sink": signal_sink,
}
