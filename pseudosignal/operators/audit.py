"""Leak audit: does any raw personal value turn up in what leaves the institution?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudosignal.functions.text import present
from pseudosignal.schema import SIGNAL_FIELDS

PERSONAL_FIELDS = (
    "id",
    "name",
    "national_id",
    "account",
    "device_id",
    "ip",
    "counterparty_id",
    "counterparty_national_id",
)
SUPPLIED_HASHES = ("device_id_hash", "ip_hash")
# Shorter values occur inside hex digits by chance.
MIN_CONTAINED_CHARS = 6


def _containing(value: Column):
    return lambda output: F.contains(output, value)


def pii_leak_audit(raw: DataFrame, signals: DataFrame, key: str = "tx_id") -> DataFrame:
    """Per raw field: values checked, equal to an output value, contained in one.

    Callers may supply device and IP hashes themselves, and these pass unchanged;
    ``not_a_hash`` counts those that are not 64 hex digits. All counts come from
    one pass over the join on the unique row key.
    """
    fields = (*PERSONAL_FIELDS, *SUPPLIED_HASHES)
    outputs = [F.col(f"_signal.{c}") for c in SIGNAL_FIELDS if c not in ("metadata", "mosaic_version")]
    outputs += [
        F.col(f"_signal.metadata.{f.name}").cast("string")
        for f in signals.schema["metadata"].dataType
    ]
    # Values are searched as they are: in JSON text some characters are escaped.
    packed = signals.select(key, F.struct(*SIGNAL_FIELDS).alias("_signal"))
    both = (
        raw.select(key, *fields)
        .join(packed, key)
        .select(
            *fields,
            F.array(*outputs).alias("_values"),
        )
    )

    counts = []
    for name in PERSONAL_FIELDS:
        value = present(F.col(name))
        long_enough = F.char_length(value) >= MIN_CONTAINED_CHARS
        inside = long_enough & F.exists(F.col("_values"), _containing(value))
        counts += [
            F.count(value).alias(f"{name}__checked"),
            F.count_if(F.array_contains(F.col("_values"), value)).alias(f"{name}__equal"),
            F.count_if(long_enough).alias(f"{name}__contained_checked"),
            F.count_if(inside).alias(f"{name}__contained"),
            F.lit(0).cast("long").alias(f"{name}__not_a_hash"),
        ]
    for name in SUPPLIED_HASHES:
        value = present(F.col(name))
        counts += [
            F.count(value).alias(f"{name}__checked"),
            F.lit(0).cast("long").alias(f"{name}__equal"),
            F.lit(0).cast("long").alias(f"{name}__contained_checked"),
            F.lit(0).cast("long").alias(f"{name}__contained"),
            F.count_if(~value.rlike(r"\A[0-9a-f]{64}\z")).alias(f"{name}__not_a_hash"),
        ]
    columns = ("checked", "equal", "contained_checked", "contained", "not_a_hash")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"), *[F.col(f"{name}__{c}").alias(c) for c in columns]
            )
            for name in fields
        ]
    )
    return both.agg(*counts).select(F.inline(rows))
