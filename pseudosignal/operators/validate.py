"""Validation: the first broken rule of each transaction, and the split by verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudosignal.functions.instants import rfc3339_seconds
from pseudosignal.functions.text import is_blank

# Fixed values of the reject texts.
NOT_EMPTY = "must be a non-empty string"
POSITIVE = "must be a positive number"
RFC3339 = "must be RFC 3339 (e.g. 2026-01-15T14:07:33Z)"
TOGETHER = "must be provided together or omitted together"
LATITUDE_RANGE = "must be between -90 and 90"
LONGITUDE_RANGE = "must be between -180 and 180"

PAYLOAD = "payload"


# The rules in order: the first one broken counts.
RULES = (
    ("id", NOT_EMPTY),
    ("name", NOT_EMPTY),
    ("account", NOT_EMPTY),
    ("amount", POSITIVE),
    ("timestamp", RFC3339),
    ("latitude/longitude", TOGETHER),
    ("latitude", LATITUDE_RANGE),
    ("longitude", LONGITUDE_RANGE),
)


def _first(cases: list[tuple[Column, str]]) -> Column:
    chain = None
    for condition, value in cases:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def reject_field(event_seconds: Column) -> Column:
    """Name of the first field that breaks a rule, NULL for a valid transaction.

    ``event_seconds`` is the parsed timestamp, NULL when it does not parse.
    """
    # NaN sorts above every number: it passes the amount rule, and the range
    # rules refuse it.
    broken = [
        is_blank(F.col("id")),
        is_blank(F.col("name")),
        is_blank(F.col("account")),
        F.expr("coalesce(amount, 0D) <= 0 or amount = double('Infinity')"),
        event_seconds.isNull(),
        F.expr("(latitude is null) <> (longitude is null)"),
        F.expr("latitude not between -90D and 90D"),
        F.expr("longitude not between -180D and 180D"),
    ]
    return _first([(condition, name) for condition, (name, _) in zip(broken, RULES, strict=True)])


def reject_text(field: str) -> Column:
    """Reject reason that belongs to the reject field in the named column."""
    return _first(
        [
            (F.col(field) == name, f"validation error: {name} - {message}")
            for name, message in RULES
        ]
    )


def validate_transactions(transactions: DataFrame) -> DataFrame:
    """Add ``reject_field`` and ``reject_reason``; both NULL for valid transactions.

    A ``decode_error`` column, as the JSON decoder leaves it, comes before all rules.
    """
    field = reject_field(rfc3339_seconds(F.col("timestamp")))
    if "decode_error" not in transactions.columns:
        return transactions.withColumn("reject_field", field).withColumn(
            "reject_reason", reject_text("reject_field")
        )
    failed = F.col("decode_error").isNotNull()
    return transactions.withColumn(
        "reject_field", F.when(failed, F.lit(PAYLOAD)).otherwise(field)
    ).withColumn(
        "reject_reason",
        F.when(failed, F.col("decode_error")).otherwise(reject_text("reject_field")),
    )


def valid_transactions(validated: DataFrame) -> DataFrame:
    """The transactions without a verdict against them."""
    return validated.where(F.col("reject_field").isNull()).drop(
        "reject_field", "reject_reason", "decode_error"
    )


def rejected_transactions(validated: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """The quarantine: row key, institution and verdict, but no personal data.

    The row itself is found by its key in the source, which stays where it is.
    """
    kept = [c for c in (*keep, "institution_id") if c in validated.columns]
    return validated.where(F.col("reject_field").isNotNull()).select(
        *kept, "reject_field", "reject_reason"
    )


def reject_summary(validated: DataFrame) -> DataFrame:
    """Number of rejects per institution, field and reason."""
    return (
        validated.where(F.col("reject_field").isNotNull())
        .groupBy("institution_id", "reject_field", "reject_reason")
        .agg(F.count(F.lit(1)).alias("rejects"))
    )
