"""From raw transactions to signals, wire records, signatures and receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudosignal.functions.amounts import amount_tier, near_threshold
from pseudosignal.functions.crypto import hmac_hex, salted_hash
from pseudosignal.functions.geo import location_zone
from pseudosignal.functions.instants import bucket_text, rfc3339_seconds, seconds_of_wellformed
from pseudosignal.functions.text import normalise_id, normalise_name, present
from pseudosignal.operators.keys import KeyRing, attach_keys
from pseudosignal.operators.validate import PAYLOAD, reject_field, reject_text
from pseudosignal.schema import (
    DEFAULT_INSTITUTION,
    DEFAULT_SIGNAL_TYPE,
    MOSAIC_VERSION,
    SCOPE_GLOBAL,
    SCOPE_LOCAL,
    SIGNAL_FIELDS,
)

UNKNOWN_INSTITUTION = "unknown_institution"

_MOSAIC_KEYS = ("pepper_ipad", "pepper_opad", "local_ipad", "local_opad")
_PIPELINE_KEYS = (*_MOSAIC_KEYS, "bank_salt", "reporting_threshold")


def default_institution(df: DataFrame) -> DataFrame:
    """Fill an absent or empty institution."""
    return df.withColumn(
        "institution_id",
        F.coalesce(present(F.col("institution_id")), F.lit(DEFAULT_INSTITUTION)),
    )


def normalised_identities(df: DataFrame, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Canonical identifiers and name, as they enter the pseudonyms."""
    return df.select(
        *keep,
        normalise_id(F.col("id")).alias("id_norm"),
        normalise_name(F.col("name")).alias("name_norm"),
        normalise_id(F.col("national_id")).alias("national_id_norm"),
        normalise_id(F.col("counterparty_id")).alias("counterparty_id_norm"),
        normalise_id(F.col("counterparty_national_id")).alias("counterparty_national_id_norm"),
    )


def _keyed(is_global: Column, message: Column) -> Column:
    """HMAC with the pepper for global scope, with salt and pepper for local scope."""
    inner = F.when(is_global, F.col("pepper_ipad")).otherwise(F.col("local_ipad"))
    outer = F.when(is_global, F.col("pepper_opad")).otherwise(F.col("local_opad"))
    return hmac_hex(inner, outer, message)


def _scope(is_global: Column) -> Column:
    return F.when(is_global, F.lit(SCOPE_GLOBAL)).otherwise(F.lit(SCOPE_LOCAL))


def _identity_message(national_id: Column) -> Column:
    """What is keyed for the customer, given the normalised national identifier."""
    return F.when(national_id != "", F.concat(F.lit("v2|id|"), national_id)).otherwise(
        F.concat(
            F.lit("v2|local|"),
            normalise_id(F.col("id")),
            F.lit("|"),
            normalise_name(F.col("name")),
        )
    )


def _destination_message(national_id: Column) -> Column:
    """What is keyed for the counterparty, NULL without one.

    The global form is that of an identity, so the two match. The fallback looks
    at the raw counterparty: one made of blanks counts as given.
    """
    return F.when(national_id != "", F.concat(F.lit("v2|id|"), national_id)).when(
        F.col("counterparty_id") != "",
        F.concat(F.lit("v2|local|"), normalise_id(F.col("counterparty_id"))),
    )


def _supplied_or_hashed(supplied: str, raw: str) -> Column:
    """A hash supplied by the caller wins over the hash of the raw value."""
    return F.coalesce(
        present(F.col(supplied)), salted_hash(present(F.col(raw)), F.col("bank_salt"))
    )


def _account_hash() -> Column:
    return salted_hash(F.coalesce(F.col("account"), F.lit("")), F.col("bank_salt"))


def _with_national_ids(df: DataFrame) -> DataFrame:
    # Used twice each, so computed once in a projection of their own.
    return df.withColumns(
        {
            "_national_id": normalise_id(F.col("national_id")),
            "_counterparty_national_id": normalise_id(F.col("counterparty_national_id")),
        }
    )


def _with_keys(df: DataFrame, ring: KeyRing, *columns: str) -> DataFrame:
    return attach_keys(default_institution(df), ring, *columns)


def _if_known(columns: dict[str, Column]) -> list[Column]:
    """The columns, NULL for rows of institutions without keys, and the reason for it."""
    known = F.coalesce(F.col("_has_key"), F.lit(False))
    return [
        *[F.when(known, column).alias(name) for name, column in columns.items()],
        F.when(~known, F.lit(UNKNOWN_INSTITUTION)).alias("reject_reason"),
    ]


def identity_mosaics(df: DataFrame, ring: KeyRing, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Identity mosaic, scope and version of each transaction.

    Here and in the other column operators, rows of an institution without keys stay,
    with NULL results and ``reject_reason``.
    """
    is_global = F.col("_national_id") != ""
    message = _identity_message(F.col("_national_id"))
    return _with_national_ids(_with_keys(df, ring, *_MOSAIC_KEYS)).select(
        *keep,
        *_if_known(
            {
                "identity_mosaic": _keyed(is_global, message),
                "mosaic_scope": _scope(is_global),
                "mosaic_version": F.lit(MOSAIC_VERSION),
            }
        ),
    )


def destination_mosaics(
    df: DataFrame, ring: KeyRing, keep: tuple[str, ...] = ("tx_id",)
) -> DataFrame:
    """Destination mosaic and scope, NULL without a counterparty."""
    is_global = F.col("_counterparty_national_id") != ""
    message = F.col("_message")
    return (
        _with_national_ids(_with_keys(df, ring, *_MOSAIC_KEYS))
        .withColumn("_message", _destination_message(F.col("_counterparty_national_id")))
        .select(
            *keep,
            *_if_known(
                {
                    "destination_mosaic": _keyed(is_global, message),
                    "destination_mosaic_scope": F.when(message.isNotNull(), _scope(is_global)),
                }
            ),
        )
    )


def salted_hashes(df: DataFrame, ring: KeyRing, keep: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Account, device and IP hashes."""
    return _with_keys(df, ring, "bank_salt").select(
        *keep,
        *_if_known(
            {
                "account_hash": _account_hash(),
                "device_id_hash": _supplied_or_hashed("device_id_hash", "device_id"),
                "ip_hash": _supplied_or_hashed("ip_hash", "ip"),
            }
        ),
    )


def near_threshold_flags(
    df: DataFrame, ring: KeyRing, keep: tuple[str, ...] = ("tx_id",)
) -> DataFrame:
    """The near-threshold flag under each institution's own limit."""
    flag = near_threshold(F.col("amount"), F.col("reporting_threshold"))
    return _with_keys(df, ring, "reporting_threshold").select(
        *keep, *_if_known({"is_near_threshold": flag})
    )


def judge(transactions: DataFrame, ring: KeyRing) -> DataFrame:
    """Verdict for each transaction, with its key-free derivations and the key columns.

    Adds ``reject_field`` and ``reject_reason``; an institution without keys is
    rejected after all other rules. This is a map-side join and projections: no
    row moves between tasks, however large one institution is.

    What needs no key is derived before the join. That keeps each generated method
    small enough for the JVM to compile; in one projection they would be too large
    and run interpreted.
    """
    verdict = reject_field(rfc3339_seconds(F.col("timestamp")))
    reason = reject_text("_verdict")
    derived = default_institution(transactions)
    if "decode_error" in derived.columns:
        verdict = F.when(F.col("decode_error").isNotNull(), F.lit(PAYLOAD)).otherwise(verdict)
        reason = F.coalesce(F.col("decode_error"), reason)
    derived = _with_national_ids(derived.withColumn("_verdict", verdict)).withColumns(
        {
            "_identity_message": _identity_message(F.col("_national_id")),
            "_destination_message": _destination_message(F.col("_counterparty_national_id")),
            # Only read for valid rows, so the form of the timestamp is known.
            "_bucket": bucket_text(seconds_of_wellformed(F.col("timestamp"))),
            "_zone": location_zone(F.col("latitude"), F.col("longitude")),
        }
    )
    unknown = F.col("_has_key").isNull()
    return attach_keys(derived, ring, *_PIPELINE_KEYS).withColumns(
        {
            "reject_field": F.coalesce(
                F.col("_verdict"), F.when(unknown, F.lit("institution_id"))
            ),
            "reject_reason": F.when(F.col("_verdict").isNotNull(), reason).when(
                unknown, F.lit(UNKNOWN_INSTITUTION)
            ),
        }
    )


def _signal_columns() -> list[Column]:
    """The columns of a signal, over a judged transaction."""
    is_global = F.col("_national_id") != ""
    to_global = F.col("_counterparty_national_id") != ""
    destination = F.col("_destination_message").isNotNull()
    metadata = F.struct(
        _account_hash().alias("account_hash"),
        amount_tier(F.col("amount")).alias("amount_tier"),
        present(F.col("branch_id")).alias("branch_id"),
        _supplied_or_hashed("device_id_hash", "device_id").alias("device_id_hash"),
        present(F.col("endpoint_type")).alias("endpoint_type"),
        _supplied_or_hashed("ip_hash", "ip").alias("ip_hash"),
        near_threshold(F.col("amount"), F.col("reporting_threshold")).alias("is_near_threshold"),
        F.col("_zone").alias("location_zone"),
    )
    return [
        F.col("institution_id"),
        F.coalesce(present(F.col("signal_type")), F.lit(DEFAULT_SIGNAL_TYPE)).alias("signal_type"),
        _keyed(is_global, F.col("_identity_message")).alias("identity_mosaic"),
        _scope(is_global).alias("mosaic_scope"),
        F.lit(MOSAIC_VERSION).alias("mosaic_version"),
        F.col("_bucket").alias("timestamp"),
        metadata.alias("metadata"),
        _keyed(to_global, F.col("_destination_message")).alias("destination_mosaic"),
        F.when(destination, _scope(to_global)).alias("destination_mosaic_scope"),
    ]


def signals_of(judged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Signals of the judged transactions that are valid, plus the ``keep`` columns."""
    # Two conditions instead of one on reject_field: the first moves below the key
    # join, the second makes it an inner join.
    valid = judged.where(F.col("_verdict").isNull() & F.col("_has_key"))
    return valid.select(*keep, *_signal_columns())


def outcomes_of(judged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per judged transaction: its verdict, and its signal if it is valid.

    Carries neither personal data nor keys, so it may be cached or stored to serve
    several outputs; see ``accepted`` and ``refused``.
    """
    signal = F.when(F.col("reject_field").isNull(), F.struct(*_signal_columns()))
    return judged.select(
        *keep, "institution_id", "reject_field", "reject_reason", signal.alias("signal")
    )


def accepted(outcomes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Signals of the outcomes."""
    return outcomes.where(F.col("reject_field").isNull()).select(*keep, "signal.*")


def refused(outcomes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Quarantine of the outcomes."""
    return outcomes.where(F.col("reject_field").isNotNull()).select(
        *keep, "institution_id", "reject_field", "reject_reason"
    )


def rejects_of(judged: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Quarantine of the judged transactions: verdicts, without personal data."""
    return judged.where(F.col("reject_field").isNotNull()).select(
        *keep, "institution_id", "reject_field", "reject_reason"
    )


def pseudonymise(
    transactions: DataFrame, ring: KeyRing, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Signals and rejects of a transaction table."""
    judged = judge(transactions, ring)
    return signals_of(judged, keep), rejects_of(judged, keep)


def wire_json(columns: Sequence[Column | str] = SIGNAL_FIELDS) -> Column:
    """JSON text of the signal columns: fixed key order, absent fields left out.

    The characters that are special in HTML are written as escapes. They occur
    only inside JSON strings, so replacing them in the whole text is safe.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
    for char, escape in (
        ("<", "\\u003c"),
        (">", "\\u003e"),
        ("&", "\\u0026"),
        (" ", "\\u2028"),
        (" ", "\\u2029"),
    ):
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def payloads(signals: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Wire record of each signal as column ``payload``."""
    return signals.select(*keep, "institution_id", wire_json().alias("payload"))


def sign_payloads(records: DataFrame, ring: KeyRing) -> DataFrame:
    """Add ``signature``, the HMAC of the payload bytes under the institution's secret."""
    keyed = attach_keys(records, ring, "signing_ipad", "signing_opad")
    return keyed.select(
        *[F.col(c) for c in records.columns],
        hmac_hex(F.col("signing_ipad"), F.col("signing_opad"), F.col("payload")).alias("signature"),
    )


def receipts(
    signals: DataFrame, status: str = "queued", keep: tuple[str, ...] = ("tx_id",)
) -> DataFrame:
    """What the submitter gets back: the beginning of the mosaic, never all of it."""
    return signals.select(
        *keep,
        F.lit(status).alias("status"),
        F.concat(F.substring("identity_mosaic", 1, 16), F.lit("...")).alias("identity_mosaic"),
        "mosaic_scope",
    )


def flat(signals: DataFrame) -> DataFrame:
    """Signals with the metadata fields as columns ``meta_*``."""
    fields = [
        F.col(f"metadata.{f.name}").alias(f"meta_{f.name}")
        for f in signals.schema["metadata"].dataType.fields
    ]
    return signals.select(*[c for c in signals.columns if c != "metadata"], *fields)
