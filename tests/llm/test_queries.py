"""The registered queries: against SQL where it can say them, else the test that stands for it."""

from __future__ import annotations

import importlib.util
import os

import pytest

from pseudosignal.llm import catalogue

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "../..")
spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "tools/check_oracle.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

SMALL = "/root/testdata/sf0.001"

# Queries without SQL, and the file of their tests against brute force or held-out rows.
OTHERWISE = {
    "op3_secret_scan": "test_secrets.py",
    "op6_learned_partitions": "test_vectors.py",
    "op7_pii_surrogates": "test_surrogates.py",
    "op8_toxicity": "test_toxicity.py",
    "op9_language_id": "test_language.py",
    "op10_power_of_two_packing": "test_packing.py",
    "op12_document_fingerprints": "test_fingerprints.py",
}


def test_every_query_is_tested():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE) | set(OTHERWISE)
    for name in OTHERWISE.values():
        assert os.path.exists(os.path.join(os.path.dirname(__file__), name))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    assert check.compare(spark, check.connect(SMALL), name, SMALL) == "ok"
