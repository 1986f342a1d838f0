"""RFC 3339 timestamps and 15-minute UTC buckets, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pseudosignal.schema import TIME_UNKNOWN

BUCKET_SECONDS = 15 * 60
_DAY = 86_400
_SLOT_CLOCKS = [f"T{h:02d}:{m:02d}:00Z" for h in range(24) for m in range(0, 60, 15)]

# Accepted timestamps: seconds and an offset are mandatory, a fraction may follow a
# dot or a comma, the hour may have one digit, an offset may reach 24 hours and
# 60 minutes. Only calendar days are left to check.
_RFC3339 = (
    r"\A\d{4}-\d{2}-\d{2}T(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d+)?"
    r"(?:Z|[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60))\z"
)


def seconds_of_wellformed(text: Column) -> Column:
    """Epoch seconds of a timestamp that has the accepted form; NULL for a day like Feb 30.

    The clock is read as UTC and the offset subtracted as plain arithmetic: time
    zone types stop at 18 hours. Fractions are dropped, they cannot move a second
    to another bucket.
    """
    # 19 characters hold the clock; after a one-digit hour one more, which is trimmed.
    clock = F.rtrim(F.substring(text, 1, 19), F.lit("Z+-.,"))
    as_utc = F.unix_seconds(F.concat(clock, F.lit("Z")).try_cast("timestamp"))
    # "+hh:mm" reads as an interval of hours and minutes; "Z" counts as none.
    hours = F.substring(text, -6, 3).try_cast("int")
    minutes = F.concat(F.substring(text, -6, 1), F.substring(text, -2, 2)).try_cast("int")
    return as_utc - F.when(F.endswith(text, F.lit("Z")), F.lit(0)).otherwise(
        hours * 3600 + minutes * 60
    )


def rfc3339_seconds(text: Column) -> Column:
    """Epoch seconds of an RFC 3339 timestamp, NULL when it is not one."""
    return F.when(text.rlike(_RFC3339), seconds_of_wellformed(text))


def _utc_date(seconds: Column) -> Column:
    day = F.floor(seconds / F.lit(float(_DAY))).cast("int")
    # Years above 9999 are printed with a plus sign.
    return F.ltrim(F.date_from_unix_date(day).cast("string"), F.lit("+"))


def utc_text(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of epoch seconds."""

    def two_digits(unit: int, modulus: int) -> Column:
        number = F.pmod(F.floor(seconds / F.lit(float(unit))), F.lit(modulus))
        return F.lpad(number.cast("string"), 2, "0")

    return F.concat(
        _utc_date(seconds),
        F.lit("T"),
        two_digits(3600, 24),
        F.lit(":"),
        two_digits(60, 60),
        F.lit(":"),
        two_digits(1, 60),
        F.lit("Z"),
    )


def bucket_text(seconds: Column) -> Column:
    """15-minute bucket of epoch seconds as text, TIME_UNKNOWN for NULL."""
    slot = F.pmod(F.floor(seconds / F.lit(float(BUCKET_SECONDS))), F.lit(_DAY // BUCKET_SECONDS))
    clock = F.element_at(F.lit(_SLOT_CLOCKS), (slot + 1).cast("int"))
    return F.coalesce(F.concat(_utc_date(seconds), clock), F.lit(TIME_UNKNOWN))


def time_bucket(text: Column) -> Column:
    """15-minute UTC bucket of a timestamp text, TIME_UNKNOWN when it does not parse."""
    return bucket_text(rfc3339_seconds(text))


def bucket_instant(bucket: Column) -> Column:
    """Bucket text as a TIMESTAMP; NULL for TIME_UNKNOWN."""
    return F.timestamp_seconds(rfc3339_seconds(bucket))
