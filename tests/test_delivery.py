"""Delivery bookkeeping, admission and counters."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pseudosignal.operators import admission, delivery, metrics
from pseudosignal.operators.membership import maybe_in

T0 = datetime(2026, 1, 15, 14, 0, tzinfo=timezone.utc)


def outbox_of(spark, *rows):
    """(signal_id, institution, seconds, seq, payload)"""
    return spark.createDataFrame(
        [(s, i, q, T0 + timedelta(seconds=t), p) for s, i, t, q, p in rows],
        "signal_id bigint, institution_id string, seq bigint, enqueued_at timestamp, payload string",
    )


def attempts_of(spark, codes: dict):
    rows = [
        (signal, "B", n + 1, T0 + timedelta(seconds=100 * signal + n), code, 10)
        for signal, listed in codes.items()
        for n, code in enumerate(listed)
    ]
    return spark.createDataFrame(
        rows,
        "signal_id bigint, institution_id string, attempt_no int, attempted_at timestamp,"
        " status_code int, elapsed_ms bigint",
    )


def by_id(df):
    return {r["signal_id"]: r for r in df.collect()}


def test_outcome_classes(spark):
    codes = {
        200: "delivered", 201: "delivered", 202: "retry", 204: "retry", 301: "retry", 399: "retry",
        400: "permanent", 401: "permanent", 404: "permanent", 428: "permanent", 429: "retry",
        430: "permanent", 499: "permanent", 500: "retry", 503: "retry", None: "retry",
    }
    df = spark.createDataFrame([(c,) for c in codes], "status_code int")
    rows = {r["status_code"]: r["outcome"] for r in delivery.delivery_outcomes(df).collect()}
    assert rows == codes


@pytest.fixture(scope="module")
def queue(spark):
    outbox = outbox_of(
        spark,
        (1, "B", 0, 1, "{1}"), (2, "B", 1, 2, "{2}"), (3, "B", 2, 3, "{3}"), (4, "B", 3, 4, "{4}"),
        (5, "B", 4, 5, None), (6, "C", 9, 7, "{6}"), (7, "C", 9, 6, "{7}"), (8, "D", 0, 8, "{8}"),
    )
    attempts = attempts_of(
        spark,
        {1: [500, 500, 200], 2: [401], 3: [503, None, 429], 8: [201], 7: [500] * 9, 99: [200]},
    )
    return outbox, attempts


def test_states(queue):
    rows = by_id(delivery.delivery_state(*queue))
    assert {k: (r["state"], r["attempts"]) for k, r in rows.items()} == {
        1: ("delivered", 3), 2: ("dead", 1), 3: ("pending", 3), 4: ("pending", 0), 5: ("dead", 0),
        6: ("pending", 0), 7: ("pending", 9), 8: ("delivered", 1),
    }


def test_dead_letters(queue):
    rows = by_id(delivery.dead_letters(*queue))
    assert {k: (r["reason"], r["payload"]) for k, r in rows.items()} == {
        2: ("rejected", "{2}"), 5: ("unreadable", None),
    }


def test_backlog_in_submission_order(queue):
    rows = delivery.pending_backlog(*queue).collect()
    assert [(r["institution_id"], r["signal_id"], r["payload"]) for r in rows] == [
        ("B", 3, "{3}"), ("B", 4, "{4}"), ("C", 7, "{7}"), ("C", 6, "{6}"),
    ]


def test_queue_heads_and_retry_waits(queue):
    state = delivery.delivery_state(*queue)
    heads = {r["institution_id"]: (r["signal_id"], r["attempts"]) for r in delivery.queue_heads(state).collect()}
    assert heads == {"B": (3, 3), "C": (7, 9)}
    rows = by_id(delivery.retry_schedule(state))
    assert {k: r["wait_seconds"] for k, r in rows.items()} == {3: 4, 4: 0, 6: 0, 7: 30}
    assert rows[3]["next_attempt_at"] == (T0 + timedelta(seconds=306)).replace(tzinfo=None)
    assert rows[4]["next_attempt_at"] is None


def test_waits_double_up_to_thirty_seconds(spark):
    codes = {n: [500] * n for n in range(1, 9)}
    outbox = outbox_of(spark, *[(n, "B", n, n, "{}") for n in codes])
    rows = by_id(delivery.retry_schedule(delivery.delivery_state(outbox, attempts_of(spark, codes))))
    assert [rows[n]["wait_seconds"] for n in codes] == [1, 2, 4, 8, 16, 30, 30, 30]


def test_retry_budget(spark):
    rows = by_id(
        delivery.retry_budget(
            attempts_of(spark, {1: [500, 500, 200], 2: [401], 3: [500, 500, 500], 4: [503], 5: [200],
                                6: [500, 500, None, 200]})
        )
    )
    assert {k: (r["result"], r["attempts"], r["waited_ms"]) for k, r in rows.items()} == {
        1: ("delivered", 3, 750), 2: ("permanent", 1, 0), 3: ("exhausted", 3, 750),
        4: ("pending", 1, 0), 5: ("delivered", 1, 0), 6: ("exhausted", 3, 750),
    }


def test_counters(spark, queue):
    outbox, attempts = queue
    state = delivery.delivery_state(outbox, attempts)
    refusals = spark.createDataFrame(
        [(4, "B", False), (3, "B", True), (77, "E", False)],
        "signal_id bigint, institution_id string, admitted boolean",
    )
    rows = {r["institution_id"]: r for r in metrics.queued_counters(state, refusals).collect()}
    # Signal 4 was refused, so it is not processed.
    assert tuple(rows["B"])[2:] == (4, 1, 2, 1, 0, 0)
    assert tuple(rows["E"])[2:] == (0, 0, 0, 1, 0, 0)
    depth = {r["institution_id"]: r["spool_depth"] for r in metrics.backlog_depth(state).collect()}
    assert depth == {"B": 2, "C": 2, "D": 0}
    budget = delivery.retry_budget(attempts)
    sync = metrics.synchronous_counters(budget).first()
    # Delivered: signals 1 (3 attempts, 750 ms of waits), 8 and 99.
    assert sync["mode"] == "synchronous"
    assert (sync["signals_processed"], sync["signals_forwarded"]) == (3, 3)
    assert sync["forward_failures"] == 3
    assert sync["processing_time_ms_total"] == 30 + 750 + 10 + 10


# --- admission ---------------------------------------------------------------------


def admit(spark, arrivals, depth, limit):
    df = spark.createDataFrame(
        arrivals, "signal_id bigint, institution_id string, enqueued_at timestamp, seq bigint"
    )
    current = spark.createDataFrame(
        list(depth.items()) or [("none", 0)], "institution_id string, spool_depth bigint"
    )
    out = admission.admission_control(df, current, limit)
    rows = out.collect()
    assert len(rows) == len(arrivals)
    assert all((r["reject_reason"] == "spool_full") == (not r["admitted"]) for r in rows)
    return {r["signal_id"] for r in rows if r["admitted"]}


def model(arrivals, depth, limit):
    admitted, held = set(), dict(depth)
    for signal, institution, at, seq in sorted(arrivals, key=lambda r: (r[1], r[2], r[3])):
        if held.get(institution, 0) < limit:
            held[institution] = held.get(institution, 0) + 1
            admitted.add(signal)
    return admitted


def test_full_queue_refuses(spark):
    arrivals = [(1, "B", T0, 1), (2, "B", T0, 2)]
    assert admit(spark, arrivals, {}, 1) == {1}
    assert admit(spark, arrivals, {"B": 1}, 1) == set()
    assert admit(spark, arrivals, {"B": 5}, 1) == set()
    assert admit(spark, arrivals, {}, 2) == {1, 2}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("bound", "in_one_task"), [(100_000, 1 << 20), (0, 0)])
def test_admission_equals_one_by_one_model(spark, monkeypatch, seed, bound, in_one_task):
    monkeypatch.setattr(admission, "MAX_BROADCAST_INSTITUTIONS", bound)
    monkeypatch.setattr(admission, "MAX_SORTED", in_one_task)
    rng = random.Random(seed)
    sequences = rng.sample(range(2**62), 1500) + list(range(1500))
    rng.shuffle(sequences)
    arrivals = []
    for number in range(3000):
        # One institution has most rows; many rows share one microsecond.
        institution = rng.choice("AAAAAABC")
        at = rng.choice(
            [T0, T0, T0 + timedelta(microseconds=rng.randrange(3)), T0 + timedelta(days=rng.randrange(-20000, 3)),
             datetime(1960, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=rng.randrange(10**7))]
        )
        arrivals.append((number, institution, at, sequences[number]))
    depth = {"A": rng.randrange(800), "B": 990, "Z": 3}
    limit = rng.randrange(1000, 2000)
    assert admit(spark, arrivals, depth, limit) == model(arrivals, depth, limit)


def test_no_institution_is_ranked_in_one_task(spark, queue):
    """Queue heads are an aggregate, and the cut is found from counts and the rows of one second."""
    state = delivery.delivery_state(*queue)
    heads = delivery.queue_heads(state)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in heads
    arrivals = state.select("signal_id", "institution_id", "seq", "enqueued_at")
    depth = spark.createDataFrame([], "institution_id string, spool_depth bigint")
    seconds = admission.cut_seconds(arrivals, depth, 1)
    plan = seconds._jdf.queryExecution().optimizedPlan().toString()
    # The windows run over stored counts by second; no arrival reaches them.
    assert "Window" in plan and "signal_id" not in plan and "arrivals-by-second" in str(seconds.inputFiles())


def test_attempts_are_combined_before_the_shuffle(queue):
    plan = delivery.delivery_state(*queue)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_bool_or") >= 1 or plan.count("partial_max") >= 1
    assert "payload" not in plan.split("Exchange")[0]


def test_attempt_without_answer_is_a_null_status(spark):
    df = spark.createDataFrame([(1, None)], "signal_id bigint, status_code int")
    assert df.select(delivery.outcome_class(F.col("status_code"))).first()[0] == "retry"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(plan):
    return [line for line in plan.splitlines() if "Exchange " in line]


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def wide_queue(spark, tmp_path, count=4000, refused_every=200):
    """An outbox of payloads, and attempts that refuse few and deliver most."""
    outbox = spark.range(count).selectExpr(
        "id as signal_id", "concat('B', id % 3) as institution_id", "id as seq",
        "timestamp_seconds(1700000000 + id * 60) as enqueued_at", "repeat(cast(id as string), 50) as payload",
    )
    outbox.write.parquet(str(tmp_path / "outbox"))
    code = f"case when id % {refused_every} = 0 then 401 when id % 10 < 9 then 200 else 500 end"
    spark.range(count).selectExpr(
        "id as signal_id", "'B' as institution_id", "1 as attempt_no",
        "timestamp_seconds(1700000000 + id) as attempted_at", f"{code} as status_code",
    ).write.parquet(str(tmp_path / "attempts"))
    return spark.read.parquet(str(tmp_path / "outbox")), spark.read.parquet(str(tmp_path / "attempts"))


def test_sifting_loses_nothing_and_drops_most(spark):
    ids = spark.range(0, 50_000, 7).toDF("k")
    kept = {r["k"] for r in maybe_in(spark.range(50_000).toDF("k"), "k", ids, ids.count()).collect()}
    wanted = set(range(0, 50_000, 7))
    assert wanted <= kept and len(kept - wanted) < 0.12 * 43_000
    none = spark.createDataFrame([], "k bigint")
    assert maybe_in(ids, "k", none, 0).count() == 0
    assert maybe_in(spark.sql("select cast(null as bigint) as k"), "k", ids, 10).count() <= 1


def test_only_payloads_of_dead_signals_travel(spark, no_broadcast, tmp_path):
    outbox, attempts = wide_queue(spark, tmp_path)
    dead = delivery.dead_letters(outbox, attempts)
    assert dead.count() == 20
    sifted = next(x for x in exchanges(plan_of(dead)) if "hashpartitioning(signal_id" in x)
    assert sifted
    likely = maybe_in(outbox, "signal_id", dead.select("signal_id"), 20)
    assert likely.count() < 0.2 * outbox.count()


def test_backlog_moves_payloads_once(spark, no_broadcast, tmp_path):
    outbox, attempts = wide_queue(spark, tmp_path)
    backlog = delivery.pending_backlog(outbox, attempts)
    rows = backlog.collect()
    assert len(rows) == 400
    assert rows == sorted(rows, key=lambda r: (r["institution_id"], r["enqueued_at"]))
    assert all(r["payload"] == str(r["signal_id"]) * 50 for r in rows)
    moved = [line for line in exchanges(plan_of(backlog)) if "Broadcast" not in line]
    assert sum("rangepartitioning" in line for line in moved) == 1
    # Besides that there is only the shuffle that builds the bitmap, which is without payloads.
    assert all("_row" in line for line in moved if "rangepartitioning" not in line)


def test_queue_heads_sort_nothing(spark, tmp_path):
    outbox, attempts = wide_queue(spark, tmp_path)
    heads = delivery.queue_heads(delivery.delivery_state(outbox, attempts))
    assert {r["institution_id"]: r["signal_id"] for r in heads.collect()} == {"B0": 9, "B1": 19, "B2": 29}
    assert "SortAggregate" not in plan_of(heads)


def test_queue_heads_of_odd_places(spark):
    rows = [(1, "A", 2**62, T0), (2, "A", -(2**62), T0), (3, "B", 5, datetime(1950, 1, 1)), (4, "B", 1, T0), (5, "C", None, None)]
    state = spark.createDataFrame(
        [(*r, "pending", 0, None) for r in rows],
        "signal_id bigint, institution_id string, seq bigint, enqueued_at timestamp, state string, attempts bigint,"
        " last_attempt_at timestamp",
    )
    heads = {r["institution_id"]: r["signal_id"] for r in delivery.queue_heads(state).collect()}
    assert heads == {"A": 2, "B": 3, "C": 5}


def test_second_pass_of_admission_reads_the_cut_only(spark, tmp_path):
    outbox, _ = wide_queue(spark, tmp_path)
    outbox.sortWithinPartitions("enqueued_at").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "a"))
    arrivals = spark.read.parquet(str(tmp_path / "a")).drop("payload")
    depth = spark.createDataFrame([], "institution_id string, spool_depth bigint")
    gates = admission.cut_seconds(arrivals, depth, 100).collect()
    seconds = [r["second"] for r in gates]
    assert max(seconds) - min(seconds) < 600 and {r["free"] for r in gates} == {1}
    cut = spark.createDataFrame([(r["institution_id"], r["second"], r["free"]) for r in gates], "institution_id string, second bigint, free bigint")
    found = admission.second_rows(arrivals, F.broadcast(cut), min(seconds), max(seconds))
    assert found.count() == 3
    plan = plan_of(found)
    assert "GreaterThanOrEqual(enqueued_at" in plan and "LessThan(enqueued" in plan
