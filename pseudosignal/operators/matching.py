"""The matching rules a receiver of signals has to keep.

Only global mosaics are compared across institutions, local mosaics and salted
hashes within one institution only, and nothing across mosaic versions. Every rule
reduces the signals to (mosaic, institution) counts first; these combine before the
shuffle, so a mosaic with a third of all signals costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pseudosignal.functions.instants import rfc3339_seconds, utc_text

from pseudosignal.schema import SCOPE_GLOBAL

FINGERPRINTS = ("account_hash", "device_id_hash", "ip_hash")


def version() -> Column:
    """Mosaic version; signals of the first generation do not carry one."""
    return F.coalesce(F.col("mosaic_version"), F.lit(1))


def _presence(signals: DataFrame) -> DataFrame:
    """Signals per global identity and institution."""
    return (
        signals.where(F.col("mosaic_scope") == SCOPE_GLOBAL)
        .groupBy(version().alias("mosaic_version"), "identity_mosaic", "institution_id")
        .agg(F.count(F.lit(1)).alias("_signals"))
    )


def cross_institution(signals: DataFrame, min_institutions: int = 2) -> DataFrame:
    """Global identities seen at several institutions."""
    return (
        _presence(signals)
        .groupBy("mosaic_version", "identity_mosaic")
        .agg(
            F.count(F.lit(1)).alias("institutions"),
            F.sum("_signals").alias("signals"),
        )
        .where(F.col("institutions") >= min_institutions)
    )


def within_institution(signals: DataFrame, min_signals: int = 2) -> DataFrame:
    """Identities, local or global, with several signals at one institution."""
    # As numbers, which a hash aggregate can hold; TIME_UNKNOWN is NULL and never a bound.
    seconds = rfc3339_seconds(F.col("timestamp"))
    grouped = (
        signals.groupBy(
            version().alias("mosaic_version"), "institution_id", "mosaic_scope", "identity_mosaic"
        )
        .agg(
            F.count(F.lit(1)).alias("signals"),
            F.count_if(F.col("metadata.is_near_threshold")).alias("near_threshold_signals"),
            F.min(seconds).alias("first_bucket"),
            F.max(seconds).alias("last_bucket"),
        )
        .where(F.col("signals") >= min_signals)
    )
    return grouped.withColumns(
        {name: utc_text(F.col(name)) for name in ("first_bucket", "last_bucket")}
    )


def route_links(signals: DataFrame) -> DataFrame:
    """Transfers to a global identity and the institutions where that identity acts itself.

    One row per source institution, mosaic and target institution. Both sides are
    reduced to one row per mosaic and institution before they meet, so the join
    cannot multiply individual signals.
    """
    sent = (
        signals.where(F.col("destination_mosaic_scope") == SCOPE_GLOBAL)
        .groupBy(
            version().alias("mosaic_version"),
            F.col("destination_mosaic").alias("identity_mosaic"),
            F.col("institution_id").alias("source_institution"),
        )
        .agg(F.count(F.lit(1)).alias("transfers"))
    )
    seen = _presence(signals).select(
        "mosaic_version",
        "identity_mosaic",
        F.col("institution_id").alias("target_institution"),
        F.col("_signals").alias("target_signals"),
    )
    return sent.join(seen, ["mosaic_version", "identity_mosaic"])


def shared_fingerprints(signals: DataFrame, min_identities: int = 2) -> DataFrame:
    """Account, device and IP hashes that several identities of one institution share.

    Hashes are salted by the institution, so they mean nothing outside it. One pass
    over the signals serves all three kinds.
    """
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(f"metadata.{kind}").alias("hash"))
            for kind in FINGERPRINTS
        ]
    )
    listed = signals.select(
        version().alias("mosaic_version"), "institution_id", "identity_mosaic", F.inline(kinds)
    )
    per_identity = (
        listed.where(F.col("hash").isNotNull())
        .groupBy("mosaic_version", "institution_id", "kind", "hash", "identity_mosaic")
        .agg(F.count(F.lit(1)).alias("_signals"))
    )
    return (
        per_identity.groupBy("mosaic_version", "institution_id", "kind", "hash")
        .agg(F.count(F.lit(1)).alias("identities"), F.sum("_signals").alias("signals"))
        .where(F.col("identities") >= min_identities)
    )


def version_partition(signals: DataFrame) -> DataFrame:
    """Per mosaic version: signals, global identities, and those at several institutions."""
    per_identity = (
        signals.groupBy(
            version().alias("mosaic_version"),
            (F.coalesce(F.col("mosaic_scope"), F.lit("")) == SCOPE_GLOBAL).alias("_global"),
            "identity_mosaic",
            "institution_id",
        )
        .agg(F.count(F.lit(1)).alias("_signals"))
        .groupBy("mosaic_version", "_global", "identity_mosaic")
        .agg(F.count(F.lit(1)).alias("_institutions"), F.sum("_signals").alias("_signals"))
    )
    return per_identity.groupBy("mosaic_version").agg(
        F.sum("_signals").alias("signals"),
        F.count_if(F.col("_global")).alias("global_identities"),
        F.count_if(F.col("_global") & (F.col("_institutions") >= 2)).alias("matched_identities"),
    )
