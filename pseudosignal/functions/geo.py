"""Geohash zones as integer lattice arithmetic, without a loop per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pseudosignal.schema import ZONE_UNKNOWN

# Fixed value: the public geohash base-32 alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# The digits above nine as conv() writes them.
_BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUV"


def _lattice_index(value: Column, half_range: float, bits: int) -> Column:
    """Which of the 2^bits equal cells of [-half_range, half_range] holds the value.

    The cell borders ``i * step - half_range`` are exact doubles; the division is
    not, so its result is moved by one where the value lies beyond a border.
    """
    cells = 1 << bits
    step = 2.0 * half_range / cells
    guess = F.least(F.floor((value + F.lit(half_range)) / F.lit(step)), F.lit(cells - 1))
    low = guess * F.lit(step) - F.lit(half_range)
    moved = guess - (value < low).cast("long") + (value >= low + F.lit(step)).cast("long")
    return F.greatest(F.lit(0), F.least(moved, F.lit(cells - 1))).cast("long")


def _spread(index: Column) -> Column:
    """Put a zero bit between the bits: the binary digits, read in base four."""
    return F.conv(F.conv(index.cast("string"), 10, 2), 4, 10).cast("long")


def location_zone(latitude: Column, longitude: Column, precision: int = 5) -> Column:
    """Geohash of a place, ZONE_UNKNOWN when absent, not a number or out of range.

    Each step refers to the step before once, so the expression stays small when
    the optimizer copies it into a filter.
    """
    if not 1 <= precision <= 12:
        raise ValueError("precision must be between 1 and 12")
    lon_bits = (5 * precision + 1) // 2
    lat_bits = 5 * precision // 2
    lon = _spread(_lattice_index(longitude, 180.0, lon_bits))
    lat = _spread(_lattice_index(latitude, 90.0, lat_bits))
    # Longitude owns the top bit, so it owns the lowest one iff the total is odd.
    code = lon + lat * 2 if (lon_bits + lat_bits) % 2 else lon * 2 + lat
    digits = F.lpad(F.conv(code.cast("string"), 10, 32), precision, "0")
    # NaN sorts above every number, so the range test refuses it as well.
    on_map = latitude.between(-90.0, 90.0) & longitude.between(-180.0, 180.0)
    return F.when(on_map, F.translate(digits, _BASE32_LETTERS, ALPHABET[10:])).otherwise(
        F.lit(ZONE_UNKNOWN)
    )
