from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from pseudosignal.operators.keys import InstitutionKeys, key_ring  # noqa: E402
from pseudosignal.schema import RAW_SCHEMA  # noqa: E402
from pseudosignal.session import tune  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = tune(
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def keys_of(institution: str, salt: str = "salt", pepper: str = "pepper", threshold: float = 10000.0):
    return InstitutionKeys(institution, salt, pepper, "secret", threshold)


@pytest.fixture(scope="session")
def ring(spark):
    """BNK has salt and pepper of the golden vectors; A and B share a pepper."""
    return key_ring(
        spark,
        [
            keys_of("BNK"),
            keys_of("BNK_A", "salt_a", "shared_pepper"),
            keys_of("BNK_B", "salt_b", "shared_pepper"),
            keys_of("BNK_OTHER", "salt_a", "other_pepper"),
            keys_of("BNK_TEST", "salt", "test_pepper"),
            keys_of("BNK_NOLIMIT", threshold=0.0),
        ],
        min_salt_chars=1,
    )


BASE_ROW = {
    "id": "CUST-1",
    "name": "Test",
    "account": "ACC-1",
    "amount": 100.0,
    "latitude": 6.45,
    "longitude": 3.39,
    "timestamp": "2026-01-15T14:07:33Z",
}


@pytest.fixture(scope="session")
def transactions(spark):
    """Build a transaction table from partial rows; each row gets its number as tx_id."""

    def build(*changes: dict, institution: str = "BNK"):
        names = [*RAW_SCHEMA.fieldNames(), "institution_id"]
        rows = []
        for number, change in enumerate(changes):
            row = {**BASE_ROW, "institution_id": institution, **change}
            rows.append((number, *[row.get(name) for name in names]))
        ddl = "tx_id bigint, " + ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in RAW_SCHEMA
        )
        return spark.createDataFrame(rows, ddl + ", institution_id string")

    return build
