"""Every query of the engine against its DuckDB counterpart, and the shape of the entry points.

The optional subpackage has its own test of this kind.
"""

from __future__ import annotations

import importlib.util
import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

from pseudosignal.plans.catalogue import QUERIES  # noqa: E402
from pseudosignal.plans.oracle import ORACLE  # noqa: E402

spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "tools/check_oracle.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    assert check.compare(spark, duck, name, SMALL) == "ok"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "identity_mosaic" in df.columns
