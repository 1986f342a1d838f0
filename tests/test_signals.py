"""The pseudonymisation pipeline: golden vectors, scopes, presence rules, secrets."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

import pytest
from conftest import keys_of
from pyspark.sql import functions as F

from pseudosignal.operators import signals as ps
from pseudosignal.operators.audit import pii_leak_audit
from pseudosignal.operators.keys import InstitutionKeys, key_ring
from pseudosignal.plans import sample_tables as sample
from pseudosignal.schema import SIGNAL_SCHEMA

SMALL = "/root/testdata/sf0.001"


def run(transactions, ring):
    signals, rejects = ps.pseudonymise(transactions, ring, ("tx_id",))
    return (
        [r.asDict(True) for r in signals.orderBy("tx_id").collect()],
        [r.asDict() for r in rejects.orderBy("tx_id").collect()],
    )


def test_golden_vectors(transactions, ring):
    person = {"national_id": "22345678901"}
    signals, rejects = run(
        transactions(
            {**person, "institution_id": "BNK_A"},
            {"national_id": "2234-5678 901", "institution_id": "BNK_B", "id": "CIF-9", "name": "DOE, JOHN"},
            {**person, "institution_id": "BNK_TEST"},
            {"counterparty_national_id": "99887766554", "counterparty_id": "CP-1"},
            {"id": "CUST-001", "name": "John Doe"},
            {"counterparty_id": "CP123"},
            {"account": "ACC", "device_id": "device123", "ip": "192.168.1.1"},
            {**person, "institution_id": "BNK_OTHER"},
        ),
        ring,
    )
    assert rejects == []
    shared = "68ce55670c65c4540f36f5b377ca3df4791c667750b2fd11a8e18d870b00e4f4"
    assert signals[0]["identity_mosaic"] == signals[1]["identity_mosaic"] == shared
    assert signals[0]["mosaic_scope"] == signals[1]["mosaic_scope"] == "global"
    assert signals[0]["mosaic_version"] == 2
    assert signals[2]["identity_mosaic"].startswith("d433f5d2a3aedcb9")
    assert signals[3]["destination_mosaic"] == (
        "c26514102ddd90d223db25db31e6aadee6abd233385e02d20efc2723580c269e"
    )
    assert signals[3]["destination_mosaic_scope"] == "global"
    assert signals[4]["identity_mosaic"] == (
        "1db3c1505dc35af8775d3a5932a7857616201ca260c76acb308fbd3081021d01"
    )
    assert signals[4]["mosaic_scope"] == "local"
    assert signals[5]["destination_mosaic"] == (
        "d743eda65b8557afc6622f024a5b2b18f6fcbb19dc6d6dc60dc157119c3d01b6"
    )
    assert signals[5]["destination_mosaic_scope"] == "local"
    assert signals[6]["metadata"]["account_hash"] == (
        "91ce7f1d28fc80bc5e202f612c8ed7583cdbf7d961cfff6988d9b2f2f76567a3"
    )
    assert signals[6]["metadata"]["device_id_hash"] == (
        "e659172ca58ed0f7258aa84c90d326a413b2b7504e8e35fb1bc06398e497d8cd"
    )
    assert signals[6]["metadata"]["ip_hash"] == (
        "3dabdc8bd084eeba0c351e791f38d07ffe77e1ebb7509570a01fe5377caea02d"
    )
    assert signals[7]["identity_mosaic"] != shared


def test_local_identity(transactions, ring):
    signals, _ = run(
        transactions(
            {"id": "CUST-001", "name": "John Doe"},
            {"id": "cust-001", "name": "  JOHN   DOE "},
            {"id": "CUST-001", "name": "John Doe", "institution_id": "BNK_A"},
            {"id": "ab", "name": "cd"},
            {"id": "a", "name": "bcd"},
            {"id": "a|b", "name": "c"},
            {"id": "a", "name": "b|c"},
            {"id": "-", "name": "x"},
            {"national_id": "--", "id": "CUST-001", "name": "John Doe"},
            {"id": "CUST-001", "name": "Straße"},
        ),
        ring,
    )
    m = [s["identity_mosaic"] for s in signals]
    assert m[0] == m[1] == m[8]
    assert m[0] != m[2]
    assert m[3] != m[4]
    # The delimiter may occur in values; that collision is part of the format.
    assert m[5] == m[6]

    def local(message):
        return hmac.new(b"salt|pepper", message.encode(), hashlib.sha256).hexdigest()

    assert m[7] == local("v2|local||X")
    assert m[9] == local("v2|local|CUST001|STRAßE")
    assert {s["mosaic_scope"] for s in signals} == {"local"}


def test_destination_matches_identity_only_globally(transactions, ring):
    signals, _ = run(
        transactions(
            {"counterparty_id": "CP-1", "counterparty_national_id": "99887766554", "institution_id": "BNK_A"},
            {"id": "CP-1", "national_id": "99887766554", "institution_id": "BNK_B"},
            {"counterparty_id": "   "},
            {"counterparty_id": ""},
            {},
            {"counterparty_national_id": "-."},
        ),
        ring,
    )
    assert signals[0]["destination_mosaic"] == signals[1]["identity_mosaic"]
    blank = hmac.new(b"salt|pepper", b"v2|local|", hashlib.sha256).hexdigest()
    assert signals[2]["destination_mosaic"] == blank
    for signal in signals[3:]:
        assert signal["destination_mosaic"] is None
        assert signal["destination_mosaic_scope"] is None


def test_presence_rules_and_defaults(transactions, ring):
    signals, _ = run(
        transactions(
            {"latitude": None, "longitude": None, "signal_type": "", "amount": 9600.0},
            {"device_id": "d", "device_id_hash": "prehashed_device", "ip": "i", "ip_hash": "prehashed_ip",
             "branch_id": "LAG-01", "endpoint_type": "POS", "signal_type": "login"},
            {"amount": 9600.0, "institution_id": "BNK_NOLIMIT"},
            {"device_id": "", "ip": "", "branch_id": "", "endpoint_type": ""},
        ),
        ring,
    )
    first, second, third, fourth = (s["metadata"] for s in signals)
    assert first["location_zone"] == "ZONE_UNKNOWN"
    assert signals[0]["signal_type"] == "transaction"
    assert first["is_near_threshold"] is True
    assert second["device_id_hash"] == "prehashed_device"
    assert second["ip_hash"] == "prehashed_ip"
    assert (second["branch_id"], second["endpoint_type"]) == ("LAG-01", "POS")
    assert signals[1]["signal_type"] == "login"
    assert second["is_near_threshold"] is None
    assert third["is_near_threshold"] is None
    assert [fourth[k] for k in ("device_id_hash", "ip_hash", "branch_id", "endpoint_type")] == [None] * 4


def test_signal_schema(transactions, ring):
    signals, _ = ps.pseudonymise(transactions({}), ring)
    assert signals.columns == SIGNAL_SCHEMA.fieldNames()
    assert [f.dataType.simpleString() for f in signals.schema] == [
        f.dataType.simpleString() for f in SIGNAL_SCHEMA
    ]


def test_unknown_institution_goes_to_quarantine(spark, transactions, ring):
    signals, rejects = run(
        transactions(
            {"institution_id": "NOBODY"},
            {"institution_id": ""},
            {"institution_id": None, "id": " "},
            {},
        ),
        ring,
    )
    assert [s["tx_id"] for s in signals] == [3]
    assert [(r["institution_id"], r["reject_field"], r["reject_reason"]) for r in rejects] == [
        ("NOBODY", "institution_id", "unknown_institution"),
        ("BNK_DEFAULT", "institution_id", "unknown_institution"),
        ("BNK_DEFAULT", "id", "validation error: id - must be a non-empty string"),
    ]
    default = key_ring(spark, [keys_of("BNK_DEFAULT")], min_salt_chars=1)
    signals, rejects = run(transactions({"institution_id": ""}), default)
    assert signals[0]["institution_id"] == "BNK_DEFAULT" and rejects == []


def test_plain_join_beyond_the_broadcast_bound(transactions, ring, monkeypatch):
    rows = transactions({}, {"institution_id": "NOBODY"}, {"national_id": "1", "institution_id": "BNK_A"})
    small = run(rows, ring)
    monkeypatch.setattr("pseudosignal.operators.keys.MAX_BROADCAST_INSTITUTIONS", 1)
    assert not ring.fits_broadcast
    assert run(rows, ring) == small


def test_wire_record(transactions, ring):
    signals, _ = ps.pseudonymise(
        transactions(
            {"amount": 9600.0, "device_id": "d", "ip": "i", "branch_id": "A<B>&\"C\" ", "endpoint_type": "POS",
             "counterparty_id": "c"},
            {"latitude": None, "longitude": None},
        ),
        ring,
        ("tx_id",),
    )
    records = ps.sign_payloads(ps.payloads(signals, ("tx_id",)), ring).orderBy("tx_id").collect()
    full, bare = (json.loads(r["payload"]) for r in records)
    assert list(full) == [
        "institution_id", "signal_type", "identity_mosaic", "mosaic_scope", "mosaic_version",
        "timestamp", "metadata", "destination_mosaic", "destination_mosaic_scope",
    ]
    assert list(full["metadata"]) == sorted(full["metadata"]) and len(full["metadata"]) == 8
    assert full["metadata"]["branch_id"] == "A<B>&\"C\" "
    assert "A\\u003cB\\u003e\\u0026\\\"C\\\"\\u2028" in records[0]["payload"]
    assert list(bare) == list(full)[:7]
    assert list(bare["metadata"]) == ["account_hash", "amount_tier", "location_zone"]
    for r in records:
        want = hmac.new(b"secret", r["payload"].encode(), hashlib.sha256).hexdigest()
        assert r["signature"] == want


def test_receipt_shows_only_the_beginning_of_the_mosaic(transactions, ring):
    signals, _ = ps.pseudonymise(transactions({}), ring, ("tx_id",))
    receipt = ps.receipts(signals).first()
    assert re.fullmatch(r"[0-9a-f]{16}\.\.\.", receipt["identity_mosaic"])
    assert receipt["status"] == "queued"


def test_nothing_personal_in_signals_or_quarantine(spark):
    raw = sample.raw_tx(spark, SMALL)
    signals, rejects = ps.pseudonymise(raw, sample.sample_ring(spark), ("tx_id",))
    rows = {r["field"]: r for r in pii_leak_audit(raw, signals).collect()}
    assert len(rows) == 10
    assert all(r["equal"] == r["contained"] == 0 for r in rows.values())
    assert rows["id"]["checked"] == signals.count()
    assert rows["device_id_hash"]["not_a_hash"] == rows["device_id_hash"]["checked"] > 0
    assert rejects.columns == ["tx_id", "institution_id", "reject_field", "reject_reason"]


def test_audit_finds_a_leak(transactions, ring):
    raw = transactions({"branch_id": "CUST-1"}, {"branch_id": "x CUST-1 y"}, {"device_id_hash": "ACC-1"})
    signals, _ = ps.pseudonymise(raw, ring, ("tx_id",))
    rows = {r["field"]: r for r in pii_leak_audit(raw, signals).collect()}
    assert (rows["id"]["equal"], rows["id"]["contained"]) == (1, 2)
    assert (rows["account"]["equal"], rows["account"]["contained"]) == (1, 0)  # five characters
    assert rows["device_id_hash"]["not_a_hash"] == 1


# --- keys and plans ----------------------------------------------------------------


def test_key_ring_checks_its_input(spark):
    good = InstitutionKeys("A", "s" * 32, "pepper", "secret")
    assert "ssss" not in repr(good) and "pepper" not in repr(good) and "secret" not in repr(good)
    assert repr(key_ring(spark, [good])) == "KeyRing(1 institutions)"
    with pytest.raises(ValueError, match="duplicate"):
        key_ring(spark, [good, good])
    with pytest.raises(ValueError, match="at least 32"):
        key_ring(spark, [InstitutionKeys("A", "short", "p", "h")])
    with pytest.raises(ValueError, match="required"):
        key_ring(spark, [InstitutionKeys("A", "s" * 32, "", "h")])
    with pytest.raises(ValueError, match="empty"):
        key_ring(spark, [InstitutionKeys("", "s" * 32, "p", "h")])
    with pytest.raises(ValueError, match="no such key"):
        key_ring(spark, [good]).table("regional_pepper")


def plan_of(df) -> str:
    execution = df._jdf.queryExecution()
    return execution.toString() + execution.executedPlan().toString()


def test_ingest_plan_has_no_shuffle_no_python_and_no_keys(spark, transactions, ring, tmp_path):
    path = str(tmp_path / "raw")
    transactions({}).write.parquet(path)
    raw = spark.read.parquet(path)
    signals, rejects = ps.pseudonymise(raw, ring)
    signed = ps.sign_payloads(ps.payloads(signals), ring)
    secrets = ["shared_pepper", "test_pepper", "salt_a", "salt|"]
    pads = [p.hex() for p in ps_pads("salt|pepper")] + [p.hex() for p in ps_pads("secret")]
    for df in (signals, rejects, signed):
        text = plan_of(df)
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in physical and "SortMergeJoin" not in physical
        assert "BroadcastHashJoin" in physical
        assert "Python" not in physical and "ArrowEval" not in physical
        for secret in (*secrets, *pads):
            assert secret not in text.lower()
    # Rejects need neither hashes nor the columns that only feed them.
    scan = next(line for line in plan_of(rejects).splitlines() if "FileScan" in line)
    assert "ReadSchema" in scan and "device_id" not in scan and "counterparty" not in scan


def ps_pads(key):
    from pseudosignal.functions import hmac_pads

    return hmac_pads(key)


def test_flagship_counts(spark):
    signals, rejects = ps.pseudonymise(
        sample.raw_tx(spark, "/root/testdata/sf0.01"), sample.sample_ring(spark)
    )
    flat = ps.flat(signals)
    row = flat.agg(
        F.count(F.lit(1)),
        F.count_if(F.col("meta_amount_tier") == "TIER_1"),
        F.count_if(F.col("meta_amount_tier") == "TIER_4"),
        F.count("meta_is_near_threshold"),
        F.count_if(F.col("mosaic_scope") == "global"),
        F.count_if(F.col("destination_mosaic_scope") == "global"),
        F.count_if(F.col("destination_mosaic_scope") == "local"),
        F.count_if(F.col("meta_location_zone") == "ZONE_UNKNOWN"),
        F.count_if(F.col("meta_device_id_hash").isNull()),
    ).first()
    assert tuple(row) == (12300, 371, 4467, 4869, 8221, 2200, 4400, 3300, 2727)
    assert rejects.count() == 2700
