"""Transactions from any table with the raw columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudosignal.functions.instants import utc_text
from pseudosignal.schema import RAW_SCHEMA, REQUIRED_FIELDS


def conform(df: DataFrame, keep: tuple[str, ...] = ("tx_id", "institution_id")) -> DataFrame:
    """Project a table to the raw columns in their types, plus the ``keep`` columns it has.

    Missing optional columns become NULL; a missing required column is an error in
    the table, not in its rows. Values that do not cast become NULL, and validation
    then rejects the row. A TIMESTAMP column is an instant and becomes RFC 3339 text.
    """
    missing = [name for name in REQUIRED_FIELDS if name not in df.columns]
    if missing:
        raise ValueError(f"table lacks required columns: {', '.join(missing)}")
    columns = [F.col(name) for name in keep if name in df.columns]
    for field in RAW_SCHEMA:
        if field.name not in df.columns:
            column = F.lit(None).cast(field.dataType)
        elif field.name == "timestamp" and isinstance(
            df.schema["timestamp"].dataType, T.TimestampType
        ):
            column = utc_text(F.unix_seconds(F.col("timestamp")))
        else:
            column = F.col(field.name)
            if df.schema[field.name].dataType != field.dataType:
                column = column.try_cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def read_transactions(spark: SparkSession, path: str, source: str = "parquet", **options) -> DataFrame:
    """Read a transaction table with any Spark source (Parquet, ORC, JDBC, ...)."""
    return conform(spark.read.format(source).options(**options).load(path))
