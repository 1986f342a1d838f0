"""Column expressions: text, keyed hashes, zones, instants, amounts. No Python UDFs."""

from pseudosignal.functions.amounts import amount_tier, near_threshold
from pseudosignal.functions.crypto import hmac_hex, hmac_pads, salted_hash
from pseudosignal.functions.geo import location_zone
from pseudosignal.functions.instants import bucket_instant, rfc3339_seconds, time_bucket
from pseudosignal.functions.text import (
    is_blank,
    normalise_id,
    normalise_name,
    present,
    simple_upper,
)

__all__ = [
    "amount_tier",
    "bucket_instant",
    "hmac_hex",
    "hmac_pads",
    "is_blank",
    "location_zone",
    "near_threshold",
    "normalise_id",
    "normalise_name",
    "present",
    "rfc3339_seconds",
    "salted_hash",
    "simple_upper",
    "time_bucket",
]
