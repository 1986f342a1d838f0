"""Rows whose key may be among some ids, without moving the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of one map row; fixed by Spark's bitmap functions.
ROW_BITS = 32_768
# Map rows of 4 KiB that are broadcast at most: 64 MiB.
MAX_ROWS = 16_384
BITS_PER_ID = 12


def _spot(key: Column, rows: int) -> tuple[Column, Column]:
    """Map row and bit of a key."""
    at = F.pmod(F.xxhash64(key), F.lit(rows * ROW_BITS))
    return F.floor(at / ROW_BITS).cast("int"), F.pmod(at, F.lit(ROW_BITS)).cast("int")


def maybe_in(df: DataFrame, column: str, ids: DataFrame, expected: int) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``ids`` (a column of that name); the others
    surely are not. Rows stay where they are; join exactly afterwards.

    ``ids`` become a bitmap by hash, combined before the shuffle: 12 bits for each of the
    ``expected`` ids, 64 MiB at most, so the broadcast has a bound. Of the other rows one in
    twelve passes; beyond some 45 million ids more and more do, which costs time and no result.
    """
    wanted = -(-expected * BITS_PER_ID // ROW_BITS)
    rows = min(MAX_ROWS, 1 << max(0, wanted - 1).bit_length())
    row, bit = _spot(F.col(column), rows)
    maps = (
        ids.where(F.col(column).isNotNull())
        .select(row.alias("_row"), bit.alias("_bit"))
        .groupBy("_row")
        .agg(F.bitmap_construct_agg("_bit").alias("_map"))
    )
    octet = F.substring(F.col("_map"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(octet), 16, 10).cast("int")
    here = F.expr("shiftright(_octet, _bit % 8) & 1") == 1
    return (
        df.withColumns({"_row": row, "_bit": bit})
        .join(F.broadcast(maps), "_row")
        .withColumn("_octet", value)
        .where(here)
        .select(*df.columns)
    )
