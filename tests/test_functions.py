"""Column functions against case tables and independent models in plain Python."""

from __future__ import annotations

import hashlib
import hmac
import math
import random
import re
from datetime import date, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudosignal import functions as fn
from pseudosignal.functions.geo import ALPHABET
from pseudosignal.functions.text import simple_upper_table


def evaluate(spark, values, kind, function):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    out = df.select("i", function(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(out, key=lambda r: r["i"])]


# --- amounts -----------------------------------------------------------------------


def test_amount_tiers(spark):
    cases = {
        0.0: "TIER_1", 499.99: "TIER_1", 500.0: "TIER_1", 501.0: "TIER_2", 2500.0: "TIER_2",
        2501.0: "TIER_3", 10000.0: "TIER_3", 10001.0: "TIER_4", 999999.0: "TIER_4",
        math.nan: "TIER_4",
    }
    assert evaluate(spark, list(cases), "double", fn.amount_tier) == list(cases.values())


def test_near_threshold_is_true_or_absent(spark):
    def flag(limit):
        return lambda amount: fn.near_threshold(amount, F.lit(limit))

    amounts = [9600.0, 9000.0, 9500.0, 50000.0, 9499.99, math.nan]
    assert evaluate(spark, amounts, "double", flag(10000.0)) == [True, None, True, True, None, None]
    assert evaluate(spark, amounts, "double", flag(0.0)) == [None] * 6


# --- zones -------------------------------------------------------------------------


def zone_model(lat: float, lon: float, precision: int) -> str:
    """Exact rational arithmetic: the cell is the integer part of the scaled position."""
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        return "ZONE_UNKNOWN"
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    x = min(int((Fraction(lon) + 180) * 2**lon_bits / 360), 2**lon_bits - 1)
    y = min(int((Fraction(lat) + 90) * 2**lat_bits / 180), 2**lat_bits - 1)
    bits = ""
    for place in range(5 * precision):
        source, width = (x, lon_bits) if place % 2 == 0 else (y, lat_bits)
        bits += str(source >> (width - 1 - place // 2) & 1)
    return "".join(ALPHABET[int(bits[i : i + 5], 2)] for i in range(0, len(bits), 5))


def zones(spark, points, precision=5):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lon double")
    out = df.select(
        "i", fn.location_zone(F.col("lat"), F.col("lon"), precision).alias("z")
    ).collect()
    return [r["z"] for r in sorted(out, key=lambda r: r["i"])]


def test_known_zones(spark):
    points = {
        (57.64911, 10.40744): "u4pru", (6.4541, 3.3947): "s14kt", (90.0, 180.0): "zzzzz",
        (-90.0, -180.0): "00000", (0.0, 0.0): "s0000", (-1e-20, -1e-20): "7zzzz",
        (math.nan, 10.0): "ZONE_UNKNOWN", (91.0, 10.0): "ZONE_UNKNOWN",
        (45.0, 181.0): "ZONE_UNKNOWN", (None, None): "ZONE_UNKNOWN", (1.0, None): "ZONE_UNKNOWN",
    }
    assert zones(spark, list(points)) == list(points.values())
    near = zones(spark, [(57.649, 10.407), (57.650, 10.408)])
    assert near[0][:3] == near[1][:3]


@pytest.mark.parametrize("precision", [1, 4, 5, 8, 12])
def test_zones_match_exact_model_on_and_next_to_cell_borders(spark, precision):
    rng = random.Random(7 + precision)
    lat_step, lon_step = 180 / 2 ** (5 * precision // 2), 360 / 2 ** ((5 * precision + 1) // 2)
    points = []
    for _ in range(1500):
        lat = rng.randrange(2 ** (5 * precision // 2) + 1) * lat_step - 90
        lon = rng.randrange(2 ** ((5 * precision + 1) // 2) + 1) * lon_step - 180
        for a, b in ((lat, lon), (math.nextafter(lat, 99), math.nextafter(lon, -999)),
                     (math.nextafter(lat, -99), math.nextafter(lon, 999)),
                     (rng.uniform(-90, 90), rng.uniform(-180, 180))):
            points.append((a, b))
    assert zones(spark, points, precision) == [zone_model(*p, precision) for p in points]


def test_zone_expression_stays_small(spark):
    """A filter on the zone must not blow up the plan."""
    df = spark.range(1).selectExpr("double(id) as lat", "double(id) as lon")
    zoned = df.select(fn.location_zone(F.col("lat"), F.col("lon")).alias("z"))
    plan = zoned.where("z = 's0000'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


# --- instants ----------------------------------------------------------------------


BUCKETS = {
    "2026-01-15T14:07:33.123Z": "2026-01-15T14:00:00Z",
    "2026-01-15T14:14:59.999Z": "2026-01-15T14:00:00Z",
    "2026-01-15T14:15:00Z": "2026-01-15T14:15:00Z",
    "2026-01-15T14:29:33.123Z": "2026-01-15T14:15:00Z",
    "2026-01-15T14:44:33Z": "2026-01-15T14:30:00Z",
    "2026-01-15T14:59:33Z": "2026-01-15T14:45:00Z",
    "2026-01-15T15:07:33+01:00": "2026-01-15T14:00:00Z",
    "2026-01-15T09:07:33-05:00": "2026-01-15T14:00:00Z",
    "not-a-timestamp": "TIME_UNKNOWN",
    "2026-01-15T14:07:33": "TIME_UNKNOWN",
    "": "TIME_UNKNOWN",
    None: "TIME_UNKNOWN",
    # before 1970, far offsets, comma fraction, one-digit hour
    "1969-12-31T23:59:59.5Z": "1969-12-31T23:45:00Z",
    "2026-01-15T14:07:33+23:59": "2026-01-14T14:00:00Z",
    "2026-01-15T14:07:33-23:59": "2026-01-16T14:00:00Z",
    "2026-01-15T14:07:33+24:60": "2026-01-14T13:00:00Z",
    "2026-01-15T14:07:33,5Z": "2026-01-15T14:00:00Z",
    "2026-01-15T9:07:33Z": "2026-01-15T09:00:00Z",
    "2026-01-15T9:07:33.25-01:00": "2026-01-15T10:00:00Z",
    "2024-02-29T00:00:00Z": "2024-02-29T00:00:00Z",
    "0000-01-01T00:20:00Z": "0000-01-01T00:15:00Z",
    "9999-12-31T23:59:59-01:00": "10000-01-01T00:45:00Z",
    # not timestamps
    "2026-02-30T14:07:33Z": "TIME_UNKNOWN",
    "2025-02-29T14:07:33Z": "TIME_UNKNOWN",
    "2026-13-01T14:07:33Z": "TIME_UNKNOWN",
    "2026-00-01T14:07:33Z": "TIME_UNKNOWN",
    "2026-01-15T24:00:00Z": "TIME_UNKNOWN",
    "2026-01-15T14:60:00Z": "TIME_UNKNOWN",
    "2026-01-15T14:07:60Z": "TIME_UNKNOWN",
    "2026-01-15 14:07:33Z": "TIME_UNKNOWN",
    "2026-01-15t14:07:33z": "TIME_UNKNOWN",
    "2026-01-15T14:07Z": "TIME_UNKNOWN",
    "2026-01-15T14:07:33.Z": "TIME_UNKNOWN",
    "2026-01-15T14:07:33+0100": "TIME_UNKNOWN",
    "2026-01-15T14:07:33+25:00": "TIME_UNKNOWN",
    "2026-01-15T14:07:33Z ": "TIME_UNKNOWN",
    "2026-01-15T14:07:33Z\n": "TIME_UNKNOWN",
    " 2026-01-15T14:07:33Z": "TIME_UNKNOWN",
    "2026-1-15T14:07:33Z": "TIME_UNKNOWN",
    "01/15/2026": "TIME_UNKNOWN",
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_buckets_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert evaluate(spark, list(BUCKETS), "string", fn.time_bucket) == list(BUCKETS.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_random_instants_match_calendar_model(spark):
    rng = random.Random(11)
    texts, want = [], []
    for _ in range(3000):
        day = date(1, 1, 2) + timedelta(days=rng.randrange(3_600_000))
        h, m, s = rng.randrange(24), rng.randrange(60), rng.randrange(60)
        sign, oh, om = rng.choice((1, -1)), rng.randrange(24), rng.randrange(60)
        offset = f"{'+' if sign > 0 else '-'}{oh:02d}:{om:02d}"
        if rng.random() < 0.3:
            offset, sign = "Z", 0
        fraction = rng.choice(("", ".5", ".123456789", ",75"))
        texts.append(f"{day:%Y-%m-%d}".rjust(10, "0") + f"T{h:02d}:{m:02d}:{s:02d}{fraction}{offset}")
        seconds = (day - date(1970, 1, 1)).days * 86400 + h * 3600 + m * 60 + s
        want.append(seconds - sign * (oh * 3600 + om * 60))
    assert evaluate(spark, texts, "string", fn.rfc3339_seconds) == want


# --- text --------------------------------------------------------------------------


def test_normalisation(spark):
    ids = {
        "2234-5678 901": "22345678901", "abc.123": "ABC123", "--": "", None: "", "": "",
        " a b c\u0085": "ABC", "straße-1": "STRAßE1", "a|b": "A|B",
        "été": "ÉTÉ",
    }
    assert evaluate(spark, list(ids), "string", fn.normalise_id) == list(ids.values())
    names = {
        "  john   Doe ": "JOHN DOE", "a  b": "A B", "\tx\n": "X", "   ": "", None: "",
        "groß  über": "GROß ÜBER", "O'Neil-Smith": "O'NEIL-SMITH",
    }
    assert evaluate(spark, list(names), "string", fn.normalise_name) == list(names.values())


def test_blank_means_unicode_white_space(spark):
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace() and c not in range(0x1C, 0x20)]
    assert len(spaces) == 25
    cases = [None, "", "".join(spaces), *spaces]
    assert evaluate(spark, cases, "string", fn.is_blank) == [True] * len(cases)
    not_blank = ["a", " a", "​", "-", "0", "é", " x", "\x00", "\x1c", "~", "!"]
    assert evaluate(spark, not_blank, "string", fn.is_blank) == [False] * len(not_blank)


def test_upper_case_is_one_to_one(spark):
    letters = [chr(c) for c in range(0x20, 0x1E944) if not 0xD800 <= c <= 0xDFFF]
    upper = evaluate(spark, letters, "string", fn.simple_upper)
    assert all(len(u) == 1 for u in upper)
    expected = {
        "a": "A", "é": "É", "ß": "ß", "ŉ": "ŉ", "ǰ": "ǰ",
        "ᾳ": "ᾼ", "ᾀ": "ᾈ", "ı": "I", "ſ": "S", "µ": "Μ",
        "ǅ": "Ǆ", "ς": "Σ", "ﬁ": "ﬁ", "ა": "Ა",
        "\U00010428": "\U00010400", "ͅ": "Ι", "ẞ": "ẞ",
    }
    found = dict(zip(letters, upper, strict=True))
    assert {k: found[k] for k in expected} == expected
    source, target = simple_upper_table()
    assert len(source) == len(target) > 1000
    mixed = "aßz " + source[:50]
    assert evaluate(spark, [mixed], "string", fn.simple_upper) == ["AßZ " + target[:50]]


# --- keyed hashes ------------------------------------------------------------------


def test_hmac_matches_the_standard_library(spark):
    messages = ["", "v2|id|22345678901", "straße   \U0001f600", "x" * 500]
    for key in ("k", "k" * 64, "é" * 100, "shared_pepper"):
        inner, outer = fn.hmac_pads(key)
        rows = [(i, m, bytearray(inner), bytearray(outer)) for i, m in enumerate(messages)]
        df = spark.createDataFrame(rows, "i int, m string, ip binary, op binary")
        out = df.select("i", fn.hmac_hex(F.col("ip"), F.col("op"), F.col("m")).alias("h")).collect()
        got = [r["h"] for r in sorted(out, key=lambda r: r["i"])]
        want = [hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest() for m in messages]
        assert got == want


def test_salted_hash(spark):
    got = evaluate(spark, ["test", "test1", None], "string", lambda c: fn.salted_hash(c, F.lit("s")))
    assert got == [hashlib.sha256(b"test|s").hexdigest(), hashlib.sha256(b"test1|s").hexdigest(), None]
    assert all(re.fullmatch(r"[0-9a-f]{64}", h) for h in got[:2])


def test_result_types(spark):
    df = spark.range(1).select(
        fn.location_zone(F.lit(1.0), F.lit(2.0)).alias("zone"),
        fn.time_bucket(F.lit("2026-01-15T14:07:33Z")).alias("bucket"),
        fn.bucket_instant(F.lit("2026-01-15T14:00:00Z")).alias("instant"),
    )
    assert [f.dataType for f in df.schema] == [T.StringType(), T.StringType(), T.TimestampType()]
