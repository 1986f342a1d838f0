"""Streams equal batches, survive restarts and repeated batches, and lose nothing late."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pseudosignal.operators import metrics
from pseudosignal.operators import signals as ps
from pseudosignal.operators import validate as va
from pseudosignal.plans import catalogue
from pseudosignal.plans import sample_tables as sample
from pseudosignal.schema import SIGNAL_FIELDS
from pseudosignal.sources import conform, decode_transactions, read_lines
from pseudosignal.streaming import (
    late_rows,
    read_output,
    read_rollup,
    start_line_ingest,
    start_signal_sink,
    windowed_rollup,
)

SMALL = "/root/testdata/sf0.001"
NOW = {"availableNow": True}


def rows(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """The sample lines in five files per institution."""
    path = str(tmp_path_factory.mktemp("lines"))
    table = sample.transaction_lines(conform(sample.raw_tx(spark, SMALL)))
    table.select("institution_id", "value").repartition(5).write.mode("overwrite").partitionBy(
        "institution_id"
    ).text(path)
    return path


def ingest(spark, lines, out, ring, **options):
    source = read_lines(spark, lines, stream=True, maxFilesPerTrigger=7)
    query = start_line_ingest(source, ring, out, f"{out}/checkpoint", trigger=NOW, **options)
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_resumes(spark, lines, tmp_path):
    ring, out = sample.sample_ring(spark), str(tmp_path / "out")
    query = ingest(spark, lines, out, ring, rollup=True)
    batch = decode_transactions(read_lines(spark, lines))
    signals, rejects = ps.pseudonymise(batch, ring)
    assert rows(read_output(spark, out, "signals")) == rows(signals)
    assert rows(read_output(spark, out, "quarantine")) == rows(rejects)
    assert rows(read_rollup(spark, out)) == rows(metrics.signal_rollup(signals))
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(batches) >= 3
    observed = [p["observedMetrics"]["ingest"] for p in batches]
    assert sum(o["transactions"] for o in observed) == batch.count()
    assert sum(o["rejected"] for o in observed) == rejects.count()
    # A restart finds nothing new.
    before = rows(read_output(spark, out, "signals"))
    ingest(spark, lines, out, ring, rollup=True)
    assert rows(read_output(spark, out, "signals")) == before


def test_new_checkpoint_reads_old_input_again(spark, lines, tmp_path):
    """A query is named by its checkpoint, so another one adds its batches to the output."""
    ring, out = sample.sample_ring(spark), str(tmp_path / "out")
    source = read_lines(spark, lines, stream=True)
    for checkpoint in ("first", "second"):
        start_line_ingest(
            source, ring, out, str(tmp_path / checkpoint), trigger=NOW, rollup=True
        ).awaitTermination()
    signals, _ = ps.pseudonymise(decode_transactions(read_lines(spark, lines)), ring)
    assert rows(read_output(spark, out, "signals")) == rows(signals.unionByName(signals))


def test_stream_outputs_hold_no_personal_data(spark, lines, tmp_path):
    ring, out = sample.sample_ring(spark), str(tmp_path / "out")
    ingest(spark, lines, out, ring)
    assert read_output(spark, out, "quarantine").columns == [
        "institution_id", "reject_field", "reject_reason",
    ]
    assert read_output(spark, out, "signals").columns == list(SIGNAL_FIELDS)


def test_signal_sink(spark, transactions, ring, tmp_path):
    transactions({}, {"institution_id": "BNK_A"}).write.parquet(str(tmp_path / "raw"))
    schema = spark.read.parquet(str(tmp_path / "raw")).schema
    stream = conform(spark.readStream.schema(schema).parquet(str(tmp_path / "raw")))
    signals = ps.signals_of(ps.judge(stream, ring))
    start_signal_sink(signals, str(tmp_path / "out"), str(tmp_path / "cp"), NOW).awaitTermination()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["institution_id"] for r in back.collect()} == {"BNK", "BNK_A"}
    assert (tmp_path / "out/_spark_metadata").is_dir()


def stream_of(spark, transactions, ring, tmp_path, *batches):
    for changes in batches:
        transactions(*changes).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    schema = spark.read.parquet(str(tmp_path / "raw")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "raw"))
    return ps.signals_of(ps.judge(conform(source), ring))


def test_windowed_rollup_equals_batch_rollup(spark, transactions, ring, tmp_path):
    changes = [{"timestamp": f"2026-01-15T{h:02d}:07:33Z"} for h in (3, 4, 4, 9)] + [{"amount": 9600.0}]
    signals = stream_of(spark, transactions, ring, tmp_path, changes)
    query = (
        windowed_rollup(signals).writeStream.format("memory").queryName("rollup").outputMode("complete")
        .trigger(**NOW).start()
    )
    query.awaitTermination()
    batch, _ = ps.pseudonymise(transactions(*changes), ring)
    want = metrics.signal_rollup(batch).selectExpr(
        "to_timestamp(bucket) as window_start", "location_zone", "amount_tier", "institution_id", "signals",
        "near_threshold_signals",
    )
    assert rows(spark.table("rollup")) == rows(want)
    assert late_rows(query) == 0


def test_late_rows_are_counted(spark, transactions, ring, tmp_path):
    signals = stream_of(
        spark, transactions, ring, tmp_path,
        [{"timestamp": "2026-01-15T14:00:00Z"}],
        [{"timestamp": "2026-01-16T14:00:00Z"}],
        [{"timestamp": "2026-01-14T14:00:00Z"}],
    )
    query = (
        windowed_rollup(signals, "1 hour").writeStream.format("memory").queryName("late").outputMode("append")
        .trigger(**NOW).start()
    )
    query.awaitTermination()
    assert late_rows(query) == 1


def test_validation_works_on_streams(spark, lines):
    decoded = decode_transactions(read_lines(spark, lines, stream=True))
    assert va.validate_transactions(decoded).isStreaming


@pytest.mark.parametrize("wide", [True, False])
def test_file_stream_deals_each_batch_over_files_and_keeps_their_order(
    spark, tmp_path, monkeypatch, wide
):
    if wide:
        monkeypatch.setattr(catalogue, "LEAST_FILE", 1 << 10)
    table = spark.range(8000).repartition(6).selectExpr(
        "id", "repeat(sha2(string(id), 256), 3) as text", "int(id % 4) as place"
    )
    # Nothing has place 5, few rows have place 3, and rows without a place are left out.
    rare = table.where("place != 3 or id < 8").withColumn(
        "place", F.expr("if(id % 100 = 0, null, place)")
    )
    source = catalogue._file_stream(spark, rare, F.col("place"), (2, 5, 0, 3, 1), "dealt")
    seen = []

    def note(batch, number):
        tasks = batch.select(F.spark_partition_id()).distinct().count()
        places = batch.groupBy("place").count().collect()
        seen.append((sorted((r["place"], r["count"]) for r in places), tasks))

    query = source.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path))
    query.trigger(availableNow=True).start().awaitTermination()
    counts = {r["place"]: r["count"] for r in rare.groupBy("place").count().collect()}
    expected = [[(n, counts[n])] if n in counts else [] for n in (2, 5, 0, 3, 1)]
    assert [places for places, _ in seen] == expected
    assert (seen[0][1] > 1) == wide
