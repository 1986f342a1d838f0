"""Amount tiers and the reporting-threshold flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive upper bounds of the tiers below TIER_4.
TIER_BOUNDS = ((500.0, "TIER_1"), (2500.0, "TIER_2"), (10000.0, "TIER_3"))
TOP_TIER = "TIER_4"
NEAR_SHARE = 0.95


def amount_tier(amount: Column) -> Column:
    """Tier of an amount. NaN, which sorts above every number, is in the top tier."""
    (bound, tier), *rest = TIER_BOUNDS
    chain = F.when(amount <= F.lit(bound), tier)
    for bound, tier in rest:
        chain = chain.when(amount <= F.lit(bound), tier)
    return chain.otherwise(TOP_TIER)


def near_threshold(amount: Column, threshold: Column) -> Column:
    """TRUE from 95 % of the reporting threshold upwards, else NULL, never FALSE.

    NaN is not near anything, although Spark sorts it above every number.
    """
    near = (threshold > 0) & ~F.isnan(amount) & (amount >= threshold * F.lit(NEAR_SHARE))
    return F.when(near, F.lit(True))
