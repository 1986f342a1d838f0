"""Delivery bookkeeping over tables: outcomes, queue state, retries, admission.

Input tables::

    outbox(signal_id, institution_id, seq, enqueued_at, payload)
    attempts(signal_id, attempt_no, attempted_at, status_code)  -- NULL: transport error

``signal_id`` is unique in the outbox, and ``(enqueued_at, seq)`` is the submission
order within an institution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudosignal.operators.membership import maybe_in
from pseudosignal.sources.sinks import stored

DELIVERED = "delivered"
PERMANENT = "permanent"
RETRY = "retry"

DEAD = "dead"
PENDING = "pending"
EXHAUSTED = "exhausted"

# Fixed values of the delivery contract.
FIRST_WAIT_SECONDS = 1
LONGEST_WAIT_SECONDS = 30
MAX_RETRIES = 2
FIRST_BACKOFF_MS = 250
MAX_DEPTH = 10_000
SPOOL_FULL = "spool_full"


def outcome_class(status: Column) -> Column:
    """200 and 201 deliver; 4xx except 429 is final; all else, and no answer, may be retried."""
    return (
        F.when(status.isin(200, 201), F.lit(DELIVERED))
        .when(status.between(400, 499) & (status != 429), F.lit(PERMANENT))
        .otherwise(F.lit(RETRY))
    )


def delivery_outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts with their ``outcome``."""
    return attempts.withColumn("outcome", outcome_class(F.col("status_code")))


def _attempt_totals(attempts: DataFrame) -> DataFrame:
    """One row per attempted signal, combined before the shuffle."""
    outcome = outcome_class(F.col("status_code"))
    return attempts.groupBy("signal_id").agg(
        F.bool_or(outcome == DELIVERED).alias("_delivered"),
        F.bool_or(outcome == PERMANENT).alias("_permanent"),
        F.count(F.lit(1)).alias("_attempts"),
        F.max("attempted_at").alias("_last_attempt_at"),
    )


def delivery_state(outbox: DataFrame, attempts: DataFrame) -> DataFrame:
    """State of every signal: delivered, dead or pending, with its attempts so far.

    A signal without a readable payload cannot be sent and is dead. The payload
    itself is not carried along, so it is not shuffled.
    """
    slim = outbox.select(
        "signal_id",
        "institution_id",
        "seq",
        "enqueued_at",
        F.col("payload").isNull().alias("_unreadable"),
    )
    joined = slim.join(_attempt_totals(attempts), "signal_id", "left")
    state = (
        F.when(F.col("_delivered"), F.lit(DELIVERED))
        .when(F.col("_permanent") | F.col("_unreadable"), F.lit(DEAD))
        .otherwise(F.lit(PENDING))
    )
    return joined.select(
        "signal_id",
        "institution_id",
        "seq",
        "enqueued_at",
        state.alias("state"),
        F.coalesce(F.col("_attempts"), F.lit(0)).alias("attempts"),
        F.col("_last_attempt_at").alias("last_attempt_at"),
    )


def dead_letters(outbox: DataFrame, attempts: DataFrame) -> DataFrame:
    """Signals that left the queue undelivered, with payload and reason.

    ``rejected`` means a permanent answer, ``unreadable`` a lost payload.

    The refused ids are stored first. A bitmap of them sifts the outbox where it lies, so hardly
    any payload but those of dead signals travels to the exact join.
    """
    totals = _attempt_totals(attempts)
    finished = stored(
        totals.where(F.col("_permanent") | F.col("_delivered")).select("signal_id", "_delivered"),
        "finished",
    )
    refused = finished.where(~F.col("_delivered")).select("signal_id")

    def letters(dead: DataFrame, reason: str) -> DataFrame:
        return dead.select("signal_id", "institution_id", F.lit(reason).alias("reason"), "payload")

    likely = maybe_in(outbox, "signal_id", refused, refused.count())
    lost = outbox.where(F.col("payload").isNull()).join(
        finished.select("signal_id"), "signal_id", "left_anti"
    )
    return letters(likely.join(refused, "signal_id"), "rejected").unionByName(
        letters(lost, "unreadable")
    )


def pending_backlog(outbox: DataFrame, attempts: DataFrame) -> DataFrame:
    """Undelivered signals with their payload, in submission order per institution.

    Which signals are pending is found without payloads, and stored. A bitmap of their
    ids then sifts the outbox where it lies; what passes and the pending keys are ordered into
    ranges together, and a payload meets its key there. So payloads are moved once, to
    the place where they are sorted, and an institution that holds most of the backlog
    is spread over many tasks.
    """
    finished = (
        _attempt_totals(attempts)
        .where(F.col("_delivered") | F.col("_permanent"))
        .select("signal_id")
    )
    key = ["institution_id", "enqueued_at", "seq", "signal_id"]
    pending = stored(outbox.select(*key).join(finished, "signal_id", "left_anti"), "pending")
    payloads = maybe_in(
        outbox.where(F.col("payload").isNotNull()).select(*key, "payload"),
        "signal_id",
        pending.select("signal_id"),
        pending.count(),
    )
    keys = pending.select(*key, F.lit(None).cast("string").alias("payload"), F.lit(1).alias("_p"))
    return (
        payloads.withColumn("_p", F.lit(0))
        .unionByName(keys)
        .repartitionByRange(*key)
        .groupBy(*key)
        .agg(F.max("payload").alias("payload"), F.max("_p").alias("_p"))
        .where((F.col("_p") == 1) & F.col("payload").isNotNull())
        .select("signal_id", "institution_id", "seq", "enqueued_at", "payload")
        .orderBy("institution_id", "enqueued_at", "seq", "signal_id")
    )


# Larger than any sequence number.
_PLACES = str(1 << 64)


def queue_heads(state: DataFrame) -> DataFrame:
    """The one signal per institution that may be attempted next: the oldest pending one.

    Instant and sequence number make one number, whose minimum is a hash aggregate
    that combines before the shuffle; ranking the queue would move each whole queue to one
    task. The head itself is then one join on institution and number, which no other row shares.
    """
    number = "decimal(38,0)"
    place = (
        F.coalesce(F.unix_micros("enqueued_at"), F.lit(-(1 << 60))).cast(number)
        * F.lit(_PLACES).cast(number)
    ).cast(number) + F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).cast(number)
    pending = state.where(F.col("state") == PENDING).withColumn("_place", place.cast(number))
    first = pending.groupBy("institution_id").agg(F.min("_place").alias("_place"))
    return pending.join(first, ["institution_id", "_place"]).select(
        "institution_id", "enqueued_at", "seq", "signal_id", "attempts", "last_attempt_at"
    )


def retry_schedule(state: DataFrame) -> DataFrame:
    """When each pending signal may be tried again once it is the head of its queue.

    The wait starts at one second and doubles with each failure in a row up to 30.
    Only the head is ever attempted and a delivery resets the count, so the
    failures in a row of a queue are those of its head.
    """
    failures = F.col("attempts")
    doublings = F.least(failures - 1, F.lit(5)).cast("double")
    wait = F.when(failures == 0, F.lit(0)).otherwise(
        F.least(
            F.lit(LONGEST_WAIT_SECONDS), F.pow(F.lit(2.0), doublings) * FIRST_WAIT_SECONDS
        ).cast("int")
    )
    waiting = state.where(F.col("state") == PENDING).withColumn("wait_seconds", wait)
    return waiting.select(
        "signal_id",
        "institution_id",
        failures.alias("failures"),
        "wait_seconds",
        (F.col("last_attempt_at") + F.make_dt_interval(secs=F.col("wait_seconds"))).alias(
            "next_attempt_at"
        ),
    )


def retry_budget(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Result of bounded synchronous delivery: the first ``max_retries + 1`` attempts count.

    ``delivered``, ``permanent``, ``exhausted`` or, with attempts left, ``pending``;
    and the waits taken between the attempts (250 ms, then doubling).
    """
    budget = max_retries + 1
    outcome = outcome_class(F.col("status_code"))
    within = attempts.where(F.col("attempt_no") <= budget)
    totals = within.groupBy("institution_id", "signal_id").agg(
        F.bool_or(outcome == DELIVERED).alias("_delivered"),
        F.bool_or(outcome == PERMANENT).alias("_permanent"),
        F.count(F.lit(1)).alias("attempts"),
        *_elapsed(attempts),
    )
    result = (
        F.when(F.col("_delivered"), F.lit(DELIVERED))
        .when(F.col("_permanent"), F.lit(PERMANENT))
        .when(F.col("attempts") >= budget, F.lit(EXHAUSTED))
        .otherwise(F.lit(PENDING))
    )
    waited = (F.lit(FIRST_BACKOFF_MS) * (F.pow(F.lit(2.0), F.col("attempts") - 1) - 1)).cast("long")
    return totals.select(
        "signal_id",
        "institution_id",
        "attempts",
        result.alias("result"),
        waited.alias("waited_ms"),
        "elapsed_ms",
    )


def _elapsed(attempts: DataFrame) -> list[Column]:
    known = "elapsed_ms" in attempts.columns
    value = F.sum("elapsed_ms") if known else F.lit(None).cast("long")
    return [value.alias("elapsed_ms")]
