"""Headline benchmark. Prints one JSON line with the seconds of each query.

The transactions are derived from the driver tables and written once, unmeasured,
as the input table; the matching queries read the signal table that the ingest
measurement wrote. Each figure is the median of three runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pseudosignal.operators import admission, audit, delivery, matching, metrics  # noqa: E402
from pseudosignal.operators import signals as ps  # noqa: E402
from pseudosignal.operators import validate as va  # noqa: E402
from pseudosignal.plans import sample_tables as sample  # noqa: E402
from pseudosignal.session import tune  # noqa: E402
from pseudosignal.sources import conform, decode_transactions, write_signals  # noqa: E402
from pseudosignal.streaming import start_line_ingest, start_windowed_rollup  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def session() -> SparkSession:
    return tune(
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-shared-"))
        .getOrCreate()
    )


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    ring = sample.sample_ring(spark)

    raw_source = sample.raw_tx(spark, SF_DIR).repartition(int(CPUS))
    raw_source.write.parquet(f"{work}/raw")
    raw = conform(spark.read.parquet(f"{work}/raw"))
    sample.transaction_lines(raw).write.parquet(f"{work}/lines")
    lines = spark.read.parquet(f"{work}/lines")
    sample.attempts(raw).write.parquet(f"{work}/attempts")
    attempts = spark.read.parquet(f"{work}/attempts")
    signals_now = ps.signals_of(ps.judge(raw, ring), ("tx_id",))
    signals_now.write.parquet(f"{work}/signals")
    signals = spark.read.parquet(f"{work}/signals")
    sample.outbox(signals, ps.wire_json()).write.parquet(f"{work}/outbox")
    outbox = spark.read.parquet(f"{work}/outbox")
    delivery.delivery_state(outbox, attempts).write.parquet(f"{work}/state")
    state = spark.read.parquet(f"{work}/state")

    runs = iter(range(1_000_000))

    def admit() -> None:
        arrivals = state.where("attempts = 0").select(
            "signal_id", "institution_id", "seq", "enqueued_at"
        )
        depth = metrics.backlog_depth(state.where("attempts > 0"))
        drain(admission.admission_control(arrivals, depth, 8000))

    def stream() -> None:
        out = f"{work}/stream-{next(runs)}"
        source = spark.readStream.schema(lines.schema).parquet(f"{work}/lines")
        start_line_ingest(
            source, ring, out, f"{out}/checkpoint", keep=("tx_id",), trigger={"availableNow": True}
        ).awaitTermination()

    def sink() -> None:
        write_signals(signals, f"{work}/signal-table", run="bench", period="month")

    parts = [f"{work}/windows-in"]
    for n in range(4):
        signals.where(F.pmod(F.xxhash64("identity_mosaic"), F.lit(4)) == n).coalesce(1).write.mode(
            "append"
        ).parquet(parts[0])

    def windowed() -> None:
        out = f"{work}/windows-{next(runs)}"
        source = spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 2)
        start_windowed_rollup(
            source.parquet(parts[0]), out, f"{out}/checkpoint", trigger={"availableNow": True}
        ).awaitTermination()

    jobs = {
        "ingest_signals": lambda: signals_now.write.parquet(f"{work}/signals-{next(runs)}"),
        "quarantine": lambda: drain(ps.rejects_of(ps.judge(raw, ring), ("tx_id",))),
        "reject_summary": lambda: drain(va.reject_summary(va.validate_transactions(raw))),
        "decode_transactions": lambda: drain(decode_transactions(lines)),
        "signed_payloads": lambda: drain(
            ps.sign_payloads(ps.payloads(signals, ("tx_id",)), ring)
        ),
        "pii_leak_audit": lambda: drain(audit.pii_leak_audit(raw, signals)),
        "delivery_state": lambda: drain(delivery.delivery_state(outbox, attempts)),
        "write_signals": sink,
        "dead_letters": lambda: drain(delivery.dead_letters(outbox, attempts)),
        "retry_schedule": lambda: drain(delivery.retry_schedule(state)),
        "retry_budget": lambda: drain(delivery.retry_budget(attempts)),
        "windowed_rollup": windowed,
        "pending_backlog": lambda: drain(delivery.pending_backlog(outbox, attempts)),
        "queue_heads": lambda: drain(delivery.queue_heads(state)),
        "admission_control": admit,
        "signal_rollup": lambda: drain(metrics.signal_rollup(signals)),
        "cross_institution": lambda: drain(matching.cross_institution(signals)),
        "within_institution": lambda: drain(matching.within_institution(signals)),
        "route_links": lambda: drain(matching.route_links(signals)),
        "shared_fingerprints": lambda: drain(matching.shared_fingerprints(signals)),
        "stream_ingest": stream,
    }
    seconds: dict[str, float] = {}
    for name, job in jobs.items():
        job()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)

    rows = raw.count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "ingest_rows": rows,
                "ingest_rows_per_sec": round(rows / seconds["ingest_signals"]),
                "spark": spark.version,
                "master": spark.sparkContext.master,
                "shuffle_partitions": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
