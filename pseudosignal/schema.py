"""Record layouts shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the wire contract.
MOSAIC_VERSION = 2
SCOPE_GLOBAL = "global"
SCOPE_LOCAL = "local"
DEFAULT_INSTITUTION = "BNK_DEFAULT"
DEFAULT_SIGNAL_TYPE = "transaction"
ZONE_UNKNOWN = "ZONE_UNKNOWN"
TIME_UNKNOWN = "TIME_UNKNOWN"

REQUIRED_FIELDS = ("id", "name", "account", "amount", "timestamp")
NUMBER_FIELDS = ("amount", "latitude", "longitude")

RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("national_id", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("device_id_hash", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("ip_hash", T.StringType()),
        T.StructField("branch_id", T.StringType()),
        T.StructField("signal_type", T.StringType()),
        T.StructField("endpoint_type", T.StringType()),
        T.StructField("counterparty_id", T.StringType()),
        T.StructField("counterparty_national_id", T.StringType()),
    ]
)
RAW_FIELDS = tuple(RAW_SCHEMA.fieldNames())

# Alphabetical, because the wire form writes the metadata keys in that order.
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("account_hash", T.StringType()),
        T.StructField("amount_tier", T.StringType()),
        T.StructField("branch_id", T.StringType()),
        T.StructField("device_id_hash", T.StringType()),
        T.StructField("endpoint_type", T.StringType()),
        T.StructField("ip_hash", T.StringType()),
        T.StructField("is_near_threshold", T.BooleanType()),
        T.StructField("location_zone", T.StringType()),
    ]
)

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("institution_id", T.StringType()),
        T.StructField("signal_type", T.StringType()),
        T.StructField("identity_mosaic", T.StringType()),
        T.StructField("mosaic_scope", T.StringType()),
        T.StructField("mosaic_version", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("metadata", METADATA_SCHEMA),
        T.StructField("destination_mosaic", T.StringType()),
        T.StructField("destination_mosaic_scope", T.StringType()),
    ]
)
SIGNAL_FIELDS = tuple(SIGNAL_SCHEMA.fieldNames())
