"""Batches appear as a whole and once, whatever is repeated, cut off, compacted or restarted."""

from __future__ import annotations

import json
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pseudosignal.operators import admission, metrics
from pseudosignal.operators import signals as ps
from pseudosignal.sources import read_signals, write_signals
from pseudosignal.streaming import commits
from pseudosignal.streaming import (
    clean,
    compact,
    read_aside,
    read_committed,
    read_counters,
    read_depth,
    read_output,
    read_rollup,
    read_verdicts,
    read_windows,
    start_admission,
    start_committed,
    start_ingest,
    start_signal_sink,
    start_windowed_rollup,
    window_counts,
)

NOW = {"availableNow": True}


def rows(df):
    return Counter(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


@pytest.fixture
def feed(spark, tmp_path):
    """Appends rows to a folder and streams it, one file a batch."""
    folder = str(tmp_path / "feed")

    def add(*frames):
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(folder)
        return (
            spark.readStream.schema(frames[0].schema)
            .option("maxFilesPerTrigger", 1)
            .parquet(folder)
        )

    return add


def run(query):
    query.awaitTermination()


def test_killed_batch_is_invisible_and_counts_once(spark, feed, transactions, ring, tmp_path, monkeypatch):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [transactions({"id": f"c{n}"}, {"id": "", "account": "x"}) for n in range(3)]
    source = feed(*batches)
    save, seen = commits.Batch.save, []

    def dying(self, table, df):
        if self.number == 1 and table == "rollup":
            seen.append(rows(read_output(spark, out, "signals")))
            raise RuntimeError("killed between signals and rollup")
        return save(self, table, df)

    monkeypatch.setattr(commits.Batch, "save", dying)
    with pytest.raises(Exception, match="killed"):
        run(start_ingest(source, ring, out, checkpoint, rollup=True, trigger=NOW))
    first, _ = ps.pseudonymise(batches[0], ring)
    # The signals of the second batch are written, and nobody sees them.
    assert len(list((tmp_path / "out/signals").iterdir())) == 2
    assert seen == [rows(first)] and rows(read_output(spark, out, "signals")) == rows(first)
    assert rows(read_rollup(spark, out)) == rows(metrics.signal_rollup(first))

    monkeypatch.setattr(commits.Batch, "save", save)
    run(start_ingest(source, ring, out, checkpoint, rollup=True, trigger=NOW))
    whole, refused = ps.pseudonymise(batches[0].unionByName(batches[1]).unionByName(batches[2]), ring)
    assert rows(read_output(spark, out, "signals")) == rows(whole)
    assert rows(read_output(spark, out, "quarantine")) == rows(refused)
    assert rows(read_rollup(spark, out)) == rows(metrics.signal_rollup(whole))
    # Counters are those of the batch functions, over both runs.
    (counts,) = read_counters(spark, out).collect()
    assert counts.asDict() == {
        "institution_id": "BNK", "transactions": 6, "signals_processed": whole.count(), "rejected": refused.count(),
    }
    # The dead attempt goes, and nothing else.
    gone = clean(spark, out, hours=0)
    assert len(gone) == 3
    assert rows(read_output(spark, out, "signals")) == rows(whole)


def test_stream_that_stopped_before_its_own_checkpoint(spark, feed, tmp_path, monkeypatch):
    """The commit is there but Spark repeats the batch: it is not run again."""
    out, calls = str(tmp_path / "out"), []
    source = feed(spark.range(3), spark.range(3, 5))
    enter = commits._enter

    def dying(spark_, out_, commit):
        enter(spark_, out_, commit)
        raise RuntimeError("stopped after the commit")

    def job(batch):
        calls.append(batch.number)
        batch.save("t", batch.rows)
        return {"n": batch.state.get("n", 0) + batch.rows.count()}

    monkeypatch.setattr(commits, "_enter", dying)
    with pytest.raises(Exception, match="stopped"):
        run(start_committed(source, out, str(tmp_path / "cp"), job, NOW))
    monkeypatch.setattr(commits, "_enter", enter)
    run(start_committed(source, out, str(tmp_path / "cp"), job, NOW))
    assert calls == [0, 1]
    assert rows(read_committed(spark, out, "t")) == rows(spark.range(5))
    assert list(commits.last_states(spark, out).values()) == [{"n": 5}]


def test_compaction_changes_nothing_to_read(spark, feed, transactions, ring, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    days = ["2026-01-15T14:07:33Z", "2026-02-15T14:07:33Z"]
    batches = [
        transactions(*[{"id": f"c{n}{d}", "timestamp": d} for d in days], institution=i)
        for n, i in enumerate(("BNK_A", "BNK_B", "BNK_A"))
    ]
    run(start_ingest(feed(*batches), ring, out, checkpoint, rollup=True, trigger=NOW))
    tables = ("signals", "quarantine", "rollup", "counters")
    before = [rows(read_output(spark, out, t)) for t in tables]
    opened = read_output(spark, out, "signals")
    assert compact(spark, out) == 3 and compact(spark, out) == 0
    assert [rows(read_output(spark, out, t)) for t in tables] == before
    assert len(commits.live_commits(spark, out)) == 1
    assert (next((tmp_path / "out/signals").glob("*/institution_id=BNK_A/bucket_date=2026-01-15"))).is_dir()
    # Who had opened the table before the compaction still can read it.
    assert rows(opened) == before[0]
    clean(spark, out, hours=0)
    run(start_ingest(feed(batches[0]), ring, out, checkpoint, rollup=True, trigger=NOW))
    more, _ = ps.pseudonymise(batches[0], ring)
    assert rows(read_output(spark, out, "signals")) == before[0] + rows(more)
    assert len(commits.live_commits(spark, out)) == 2
    # A filter reaches the folders of the compacted part.
    plan = read_output(spark, out, "signals").where("institution_id = 'BNK_B'")._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(institution_id" in plan.executedPlan().toString()


def test_nothing_committed(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch"):
        read_output(spark, str(tmp_path), "signals")


# --- windows -------------------------------------------------------------------------


def signals_at(transactions, ring, *times):
    frame, _ = ps.pseudonymise(transactions(*[{"timestamp": t} for t in times]), ring)
    return frame


def test_late_and_untimed_signals_are_set_aside(spark, feed, transactions, ring, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    hour = timedelta(hours=1)
    no_bucket = signals_at(transactions, ring, "2026-01-16T14:00:00Z").withColumn("timestamp", F.lit("TIME_UNKNOWN"))
    parts = [
        signals_at(transactions, ring, "2026-01-15T14:00:00Z", "2026-01-10T14:00:00Z"),
        signals_at(transactions, ring, "2026-01-16T14:00:00Z", "2026-01-15T13:15:00Z").unionByName(no_bucket),
        signals_at(transactions, ring, "2026-01-16T13:00:00Z", "2026-01-16T12:45:00Z", "2026-01-14T14:00:00Z"),
    ]
    run(start_windowed_rollup(feed(*parts), out, checkpoint, hour, NOW))
    assert window_counts(spark, out) == {"on_time": 5, "late": 2, "untimed": 1}
    assert Counter((r["timestamp"], r["fate"]) for r in read_aside(spark, out).collect()) == {
        ("2026-01-16T12:45:00Z", "late"): 1, ("2026-01-14T14:00:00Z", "late"): 1, ("TIME_UNKNOWN", "untimed"): 1,
    }
    final = {str(r["window_start"]): r["final"] for r in read_windows(spark, out).collect()}
    assert final == {
        "2026-01-10 14:00:00": True, "2026-01-15 13:15:00": True, "2026-01-15 14:00:00": True,
        "2026-01-16 13:00:00": False, "2026-01-16 14:00:00": False,
    }
    # After a restart the watermark and the counts go on.
    more = [signals_at(transactions, ring, "2026-01-15T20:00:00Z"), signals_at(transactions, ring, "2026-01-17T00:00:00Z")]
    run(start_windowed_rollup(feed(*more), out, checkpoint, hour, NOW))
    assert window_counts(spark, out) == {"on_time": 6, "late": 3, "untimed": 1}
    compact(spark, out)
    assert window_counts(spark, out) == {"on_time": 6, "late": 3, "untimed": 1}
    assert read_windows(spark, out).where("final").count() == 5


def test_counts_outlast_the_progress_reports(spark, feed, transactions, ring, tmp_path):
    """More batches than a query keeps progress reports of."""
    key = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        one = signals_at(transactions, ring, "2026-01-15T14:00:00Z")
        late = signals_at(transactions, ring, "2026-01-01T14:00:00Z")
        source = feed(one, *[late] * 7)
        query = start_windowed_rollup(source, str(tmp_path / "o"), str(tmp_path / "c"), timedelta(days=1), NOW)
        run(query)
        assert len(query.recentProgress) <= 2
        assert window_counts(spark, str(tmp_path / "o")) == {"on_time": 1, "late": 7, "untimed": 0}
    finally:
        spark.conf.set(key, before)


# --- admission -----------------------------------------------------------------------


def test_streamed_arrivals_get_the_verdicts_of_the_table(spark, feed, tmp_path, monkeypatch):
    rng, t0 = random.Random(3), datetime(2026, 1, 15, tzinfo=timezone.utc)
    arrivals = [(n, rng.choice("AAAB"), n, t0 + timedelta(seconds=n // 3)) for n in range(240)]
    schema = "signal_id bigint, institution_id string, seq bigint, enqueued_at timestamp"
    whole = spark.createDataFrame(arrivals, schema)
    depth = spark.createDataFrame([("A", 30), ("Z", 4)], "institution_id string, spool_depth bigint")
    parts = [spark.createDataFrame(arrivals[a : a + 60], schema) for a in range(0, 240, 60)]
    source, out, checkpoint = feed(*parts), str(tmp_path / "out"), str(tmp_path / "cp")
    save = commits.Batch.save

    def dying(self, table, df):
        if self.number == 2 and table == "counters":
            raise RuntimeError("killed")
        return save(self, table, df)

    monkeypatch.setattr(commits.Batch, "save", dying)
    with pytest.raises(Exception, match="killed"):
        run(start_admission(source, out, checkpoint, depth, 100, NOW))
    monkeypatch.setattr(commits.Batch, "save", save)
    run(start_admission(source, out, checkpoint, depth, 100, NOW))
    want = admission.admission_control(whole, depth, 100)
    assert rows(read_verdicts(spark, out)) == rows(want)
    admitted = Counter(r["institution_id"] for r in want.where("admitted").collect())
    depths = {r["institution_id"]: r["spool_depth"] for r in read_depth(spark, out).collect()}
    assert depths == {"A": 30 + admitted["A"], "B": admitted["B"], "Z": 4}
    counts = {r["institution_id"]: r["spool_rejects"] for r in read_counters(spark, out).collect()}
    assert counts["A"] == sum(a[1] == "A" for a in arrivals) - admitted["A"]
    compact(spark, out)
    assert {r["institution_id"]: r["spool_depth"] for r in read_depth(spark, out).collect()} == depths


def test_signals_that_left_make_room(spark, feed, tmp_path):
    t0 = datetime(2026, 1, 15, tzinfo=timezone.utc)
    schema = "signal_id bigint, institution_id string, seq bigint, enqueued_at timestamp, left boolean"
    parts = [
        spark.createDataFrame([(n, "A", n, t0, None) for n in range(4)], schema),
        spark.createDataFrame([(0, "A", 0, t0, True)] + [(n, "A", n, t0, False) for n in (4, 5)], schema),
    ]
    out = str(tmp_path / "out")
    run(start_admission(feed(*parts), out, str(tmp_path / "cp"), max_depth=3, trigger=NOW))
    admitted = {r["signal_id"] for r in read_verdicts(spark, out).where("admitted").collect()}
    assert admitted == {0, 1, 2, 4}


# --- sinks ---------------------------------------------------------------------------


def test_repeated_run_replaces_its_own_days_only(spark, transactions, ring, tmp_path):
    path = str(tmp_path / "table")

    def signals(institution, *days):
        frame, _ = ps.pseudonymise(
            transactions(*[{"timestamp": f"2026-01-{d}T14:07:33Z"} for d in days], institution=institution), ring
        )
        return frame.withColumn("institution_id", F.lit({"BNK_A": "007", "BNK_B": "1e3"}[institution]))

    write_signals(signals("BNK_A", 10, 11, 12), path, run="one")
    write_signals(signals("BNK_B", 11, 12), path, run="two")
    write_signals(signals("BNK_A", 11, 11, 13), path, run="one")
    got = Counter((r["institution_id"], str(r["bucket_date"])[-2:]) for r in read_signals(spark, path).collect())
    assert got == {("007", "11"): 2, ("007", "13"): 1, ("1e3", "11"): 1, ("1e3", "12"): 1}
    before = got
    with pytest.raises(Exception):
        broken = signals("BNK_A", 20).withColumn("signal_type", F.raise_error(F.lit("broken")))
        write_signals(broken, path, run="one")
    got = Counter((r["institution_id"], str(r["bucket_date"])[-2:]) for r in read_signals(spark, path).collect())
    assert got == before


@pytest.mark.parametrize("name", ["", "a/b", " x"])
def test_run_names(spark, transactions, ring, tmp_path, name):
    frame, _ = ps.pseudonymise(transactions({}), ring)
    with pytest.raises(ValueError):
        write_signals(frame, str(tmp_path), run=name)


def test_signal_sink_after_a_stop_in_the_middle(spark, feed, transactions, ring, tmp_path):
    path, checkpoint = str(tmp_path / "sink"), str(tmp_path / "cp")
    parts = [signals_at(transactions, ring, f"2026-01-{d}T14:07:33Z") for d in (10, 11)]
    run(start_signal_sink(feed(*parts), path, checkpoint, NOW))
    # A batch that was cut off leaves files that are in no log.
    folder = tmp_path / "sink/institution_id=BNK/bucket_date=2026-01-10"
    file = next(folder.glob("*.parquet"))
    (folder / "part-cut-off.parquet").write_bytes(file.read_bytes())
    more = [signals_at(transactions, ring, f"2026-01-{d}T14:07:33Z") for d in (12, 12)]
    run(start_signal_sink(feed(*more), path, checkpoint, NOW))
    days = Counter(str(r["bucket_date"])[-2:] for r in read_signals(spark, path).collect())
    assert days == {"10": 1, "11": 1, "12": 2}
