"""Admission limit: the oldest arrivals fill the free places of each queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pseudosignal.operators.delivery import MAX_DEPTH, SPOOL_FULL
from pseudosignal.operators.keys import MAX_BROADCAST_INSTITUTIONS
from pseudosignal.operators.signals import default_institution
from pseudosignal.sources.sinks import stored

_DAY_SECONDS = 86_400
_BLOCK_BITS = 21
# Arrivals of one institution in the second of its cut that are sorted in one task; of more,
# the cut is found by counting.
MAX_SORTED = 1 << 20


def _second() -> Column:
    return F.unix_seconds(F.col("enqueued_at"))


def _day(second: Column) -> Column:
    return F.floor(second / F.lit(float(_DAY_SECONDS)))


def _fix_digit(counts: DataFrame, cut: DataFrame, digit: str) -> DataFrame:
    """Fix one more digit of the cut.

    ``counts`` has the number of arrivals per institution and digit value, ``cut``
    the places left. The running total over the digit values (at most 2^21 of them
    per institution, however many rows they stand for) shows at which value the
    last admitted arrival lies.
    """
    running = F.sum("n").over(
        Window.partitionBy("institution_id")
        .orderBy(digit)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = counts.withColumn("_upto", running).join(cut, "institution_id")
    before = F.col("_upto") - F.col("n")
    return placed.where((before < F.col("free")) & (F.col("free") <= F.col("_upto"))).select(
        *[c for c in cut.columns if c not in ("free", "here")],
        digit,
        (F.col("free") - before).alias("free"),
        F.col("n").alias("here"),
    )


def cut_seconds(arrivals: DataFrame, depth: DataFrame, max_depth: int) -> DataFrame:
    """One row per institution: ``arrivals`` and ``places``; and where not all fit, the ``second`` of
    the last arrival that does, ``free`` of the ``here`` arrivals in that second fitting.

    One pass over the arrivals counts them by second; the rest looks at counts, first of days,
    then of the seconds of one day.
    """
    counts = stored(
        arrivals.groupBy("institution_id", _second().alias("second")).agg(F.count(F.lit(1)).alias("n")),
        "arrivals-by-second",
    ).withColumn("day", _day(F.col("second")))
    by_day = counts.groupBy("institution_id", "day").agg(F.sum("n").alias("n"))
    free = F.lit(max_depth) - F.coalesce(F.col("spool_depth"), F.lit(0))
    places = (
        by_day.groupBy("institution_id")
        .agg(F.sum("n").alias("arrivals"))
        .join(depth, "institution_id", "left")
        .select("institution_id", "arrivals", F.greatest(free, F.lit(0)).alias("places"))
    )
    overfull = places.where((F.col("places") > 0) & (F.col("places") < F.col("arrivals")))
    cut = overfull.select("institution_id", F.col("places").alias("free"))
    cut = _fix_digit(by_day, cut, "day")
    in_day = counts.join(cut.select("institution_id", "day"), ["institution_id", "day"]).drop("day")
    cut = _fix_digit(in_day, cut.drop("day"), "second")
    return places.join(cut, "institution_id", "left")


def _cut_in_second(at_cut: DataFrame, cut: DataFrame, most: int) -> DataFrame:
    """(institution_id, micros, seq) of the last arrival that fits, from the arrivals of the
    second of the cut (institution_id, micros, seq, free)."""
    if most <= MAX_SORTED:
        place = F.row_number().over(Window.partitionBy("institution_id").orderBy("micros", "seq"))
        return (
            at_cut.withColumn("_place", place)
            .where(F.col("_place") == F.col("free"))
            .select("institution_id", "micros", "seq")
        )
    digits = {
        "micro": F.pmod("micros", F.lit(1_000_000)),
        "seq_high": F.shiftright("seq", 2 * _BLOCK_BITS),
        "seq_mid": F.pmod(F.shiftright("seq", _BLOCK_BITS), F.lit(1 << _BLOCK_BITS)),
        "seq_low": F.pmod("seq", F.lit(1 << _BLOCK_BITS)),
    }
    rows, fixed = at_cut.drop("free").withColumns(digits), ["institution_id"]
    cut = cut.select("institution_id", "free")
    for digit in digits:
        here = rows.join(cut.drop("free", "here"), fixed)
        counts = here.groupBy("institution_id", digit).agg(F.count(F.lit(1)).alias("n"))
        cut = stored(_fix_digit(counts, cut, digit), "admission-cut")
        fixed.append(digit)
    return rows.join(cut.drop("free", "here"), fixed).select("institution_id", "micros", "seq")


def admission_control(
    arrivals: DataFrame,
    backlog_depth: DataFrame,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Add ``admitted`` and ``reject_reason`` (``spool_full``) to the arrivals.

    ``backlog_depth(institution_id, spool_depth)`` is the current depth; arrivals
    are taken oldest first until the queue holds ``max_depth``.

    Ranking the arrivals would bring each institution to one task. Instead the cut, the order
    position of the last admitted arrival, is found in two passes: counts give its
    second, and only the arrivals of that second are looked at one by one. The bounds of
    these seconds are literals, so the second pass skips all row groups elsewhere. Every
    arrival is then compared with the cut of its institution.
    """
    # Rows without institution belong to the default one, here as everywhere.
    arrivals = default_institution(arrivals)
    backlog_depth = (
        default_institution(backlog_depth.select("institution_id", "spool_depth"))
        .groupBy("institution_id")
        .agg(F.sum("spool_depth").alias("spool_depth"))
    )
    gates = stored(cut_seconds(arrivals, backlog_depth, max_depth), "admission-seconds")
    # One row per institution from here on; counted, so the broadcast has a bound.
    open_ = F.col("here") > F.col("free")
    seen = gates.agg(
        F.count(F.lit(1)).alias("institutions"),
        F.max(F.when(open_, F.col("here"))).alias("most"),
        F.min(F.when(open_, F.col("second"))).alias("first"),
        F.max(F.when(open_, F.col("second"))).alias("last"),
    ).first()

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if seen["institutions"] <= MAX_BROADCAST_INSTITUTIONS else df

    last = F.col("second") * 1_000_000 + 999_999
    if seen["most"] is not None:
        cut = gates.where(open_).select("institution_id", "second", "free")
        at_cut = stored(second_rows(arrivals, small(cut), seen["first"], seen["last"]), "admission-second")
        exact = stored(_cut_in_second(at_cut, cut, seen["most"]), "admission-cuts")
        gates = gates.join(small(exact), "institution_id", "left")
    else:
        gates = gates.withColumns({"micros": F.lit(None).cast("long"), "seq": F.lit(None).cast("long")})
    gates = gates.select(
        "institution_id",
        (F.col("places") >= F.col("arrivals")).alias("_all"),
        F.coalesce("micros", last).alias("_cut_micros"),
        # Where the whole second fits, so does every sequence number in it.
        F.coalesce(F.col("seq"), F.lit((1 << 63) - 1)).alias("_cut_seq"),
    )
    micros = F.unix_micros(F.col("enqueued_at"))
    up_to_cut = (micros < F.col("_cut_micros")) | (
        (micros == F.col("_cut_micros")) & (F.col("seq") <= F.col("_cut_seq"))
    )
    admitted = F.col("_all") | F.coalesce(up_to_cut, F.lit(False))
    return (
        arrivals.join(small(gates), "institution_id", "left")
        .withColumn("admitted", admitted)
        .withColumn("reject_reason", F.when(~F.col("admitted"), F.lit(SPOOL_FULL)))
        .select(*arrivals.columns, "admitted", "reject_reason")
    )


def second_rows(arrivals: DataFrame, cut: DataFrame, first: int, last: int) -> DataFrame:
    """Arrivals of the cut second of their institution, all of which lie from ``first`` to ``last``."""
    bounds = (F.col("enqueued_at") >= F.lit(first).cast("timestamp")) & (
        F.col("enqueued_at") < F.lit(last + 1).cast("timestamp")
    )
    near = arrivals.where(bounds).select(
        "institution_id",
        _second().alias("second"),
        F.unix_micros("enqueued_at").alias("micros"),
        F.col("seq").cast("long").alias("seq"),
    )
    return near.join(cut, ["institution_id", "second"]).select("institution_id", "micros", "seq", "free")
