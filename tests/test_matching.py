"""The receiver's matching rules, also on skewed signals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pseudosignal.operators import matching, metrics
from pseudosignal.schema import SIGNAL_SCHEMA

B1, B2 = "2026-01-15T14:00:00Z", "2026-01-15T14:15:00Z"


def signals_of(spark, *rows):
    """(institution, mosaic, scope, version, destination, destination scope, metadata)"""
    data = []
    for institution, mosaic, scope, version, target, target_scope, meta in rows:
        metadata = {f.name: meta.get(f.name) for f in SIGNAL_SCHEMA["metadata"].dataType}
        data.append(
            (institution, "transaction", mosaic, scope, version, meta.get("at", B1), metadata, target, target_scope)
        )
    return spark.createDataFrame(data, SIGNAL_SCHEMA)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def signals(spark):
    g, lo = "global", "local"
    return signals_of(
        spark,
        ("A", "m1", g, 2, "m2", g, {"account_hash": "x", "at": B2, "is_near_threshold": True}),
        ("A", "m1", g, 2, "m2", g, {"account_hash": "x", "ip_hash": "i"}),
        ("B", "m1", g, 2, None, None, {"account_hash": "x", "at": "TIME_UNKNOWN"}),
        ("A", "m2", g, 2, "m1", g, {"account_hash": "x", "device_id_hash": "d"}),
        ("C", "m2", g, None, "m1", lo, {"device_id_hash": "d"}),
        ("C", "m2", g, 1, None, None, {"device_id_hash": "d"}),
        ("B", "l1", lo, 2, None, None, {"ip_hash": "i"}),
        ("A", "l1", lo, 2, "l1", lo, {"ip_hash": "i"}),
        ("B", "l1", lo, 2, None, None, {}),
    )


def test_cross_institution_uses_global_mosaics_of_one_version(signals):
    assert tuples(matching.cross_institution(signals)) == [(2, "m1", 2, 3)]


def test_within_institution(signals):
    found = matching.within_institution(signals)
    assert tuples(found.select("mosaic_version", "institution_id", "mosaic_scope", "identity_mosaic", "signals",
                               "near_threshold_signals", "first_bucket", "last_bucket")) == [
        (1, "C", "global", "m2", 2, 0, B1, B1),
        (2, "A", "global", "m1", 2, 1, B1, B2),
        (2, "B", "local", "l1", 2, 0, B1, B1),
    ]
    alone = matching.within_institution(signals, min_signals=1).where("institution_id = 'B' and identity_mosaic = 'm1'")
    assert alone.select("first_bucket").first()[0] is None


def test_route_links(signals):
    found = matching.route_links(signals).select(
        "mosaic_version", "source_institution", "identity_mosaic", "target_institution", "transfers", "target_signals"
    )
    # A sends twice to m2, seen at A in version 2 (C has it in version 1 only), and once to m1.
    assert tuples(found) == [(2, "A", "m1", "A", 1, 2), (2, "A", "m1", "B", 1, 1), (2, "A", "m2", "A", 2, 1)]


def test_shared_fingerprints_stay_within_an_institution(signals):
    found = matching.shared_fingerprints(signals).select("mosaic_version", "institution_id", "kind", "hash",
                                                         "identities", "signals")
    assert tuples(found) == [(2, "A", "account_hash", "x", 2, 3), (2, "A", "ip_hash", "i", 2, 2)]


def test_version_partition(signals):
    found = matching.version_partition(signals).select(
        "mosaic_version", "signals", "global_identities", "matched_identities"
    )
    assert tuples(found) == [(1, 2, 1, 0), (2, 7, 2, 1)]


def test_rollup(signals):
    found = metrics.signal_rollup(signals).where("institution_id = 'A'")
    assert sorted((r["bucket"], r["signals"], r["near_threshold_signals"]) for r in found.collect()) == [
        (B1, 3, 0), (B2, 1, 1),
    ]


def test_hot_mosaic_is_reduced_before_it_is_shuffled(spark):
    """A third of the signals belong to one identity, and a third of transfers go to it."""
    n = 300_000
    hot = F.col("id") % 3 == 0
    rows = spark.range(0, n, 1, 16).select(
        F.concat(F.lit("BNK_"), (F.col("id") % 7).cast("string")).alias("institution_id"),
        F.lit("transaction").alias("signal_type"),
        F.when(hot, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("identity_mosaic"),
        F.lit("global").alias("mosaic_scope"),
        F.lit(2).alias("mosaic_version"),
        F.lit(B1).alias("timestamp"),
        F.lit("hot").alias("destination_mosaic"),
        F.lit("global").alias("destination_mosaic_scope"),
    )
    links = matching.route_links(rows)
    found = links.collect()
    assert len(found) == 49
    assert sum(r["transfers"] for r in found) == n * 7
    # The observed shuffle of the transfers is one row per task and institution.
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "partial_count" in plan
    cross = matching.cross_institution(rows).collect()
    assert [(r["identity_mosaic"], r["institutions"], r["signals"]) for r in cross] == [("hot", 7, n // 3)]
