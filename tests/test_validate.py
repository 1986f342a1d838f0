"""Validation rules, their order, and the quarantine."""

from __future__ import annotations

import math

from pseudosignal.operators import validate as va

EMPTY = "must be a non-empty string"


def verdicts(df):
    rows = va.validate_transactions(df).orderBy("tx_id").collect()
    return [(r["reject_field"], r["reject_reason"]) for r in rows]


def test_rules(transactions):
    cases = [
        ({}, None),
        ({"latitude": None, "longitude": None}, None),
        ({"id": ""}, "id"),
        ({"id": "   "}, "id"),
        ({"id": None}, "id"),
        ({"name": ""}, "name"),
        ({"name": "  "}, "name"),
        ({"account": ""}, "account"),
        ({"amount": 0.0}, "amount"),
        ({"amount": -50.0}, "amount"),
        ({"amount": None}, "amount"),
        ({"amount": math.inf}, "amount"),
        ({"amount": -math.inf}, "amount"),
        ({"amount": math.nan}, None),
        ({"timestamp": "yesterday"}, "timestamp"),
        ({"timestamp": "2026-01-15T14:07:33"}, "timestamp"),
        ({"timestamp": None}, "timestamp"),
        ({"longitude": None}, "latitude/longitude"),
        ({"latitude": None}, "latitude/longitude"),
        ({"latitude": 95.0}, "latitude"),
        ({"latitude": math.nan}, "latitude"),
        ({"longitude": -190.0}, "longitude"),
        ({"longitude": math.nan}, "longitude"),
        ({"latitude": -90.0, "longitude": 180.0}, None),
    ]
    found = verdicts(transactions(*[change for change, _ in cases]))
    assert [field for field, _ in found] == [field for _, field in cases]
    for field, reason in found:
        if field is None:
            assert reason is None
        else:
            assert reason.startswith(f"validation error: {field} - must be ")


def test_first_broken_rule_counts(transactions):
    broken = {
        "id": " ", "name": "", "account": "", "amount": 0.0, "timestamp": "x", "longitude": None,
    }
    cases, order = [], list(broken)
    for i in range(len(order)):
        cases.append({k: broken[k] for k in order[i:]})
    cases.append({"latitude": 91.0, "longitude": 181.0})
    assert [f for f, _ in verdicts(transactions(*cases))] == [
        "id", "name", "account", "amount", "timestamp", "latitude/longitude", "latitude",
    ]


def test_reason_texts(transactions):
    found = verdicts(
        transactions({"name": " "}, {"amount": 0.0}, {"timestamp": ""}, {"latitude": None}, {"latitude": -91.0},
                     {"longitude": 181.0})
    )
    assert [reason for _, reason in found] == [
        f"validation error: name - {EMPTY}",
        "validation error: amount - must be a positive number",
        "validation error: timestamp - must be RFC 3339 (e.g. 2026-01-15T14:07:33Z)",
        "validation error: latitude/longitude - must be provided together or omitted together",
        "validation error: latitude - must be between -90 and 90",
        "validation error: longitude - must be between -180 and 180",
    ]


def test_split_is_complete_and_keeps_values_untrimmed(transactions):
    validated = va.validate_transactions(transactions({"id": " C 1 "}, {"id": ""}, {"amount": -1.0}, {}))
    valid = va.valid_transactions(validated)
    rejected = va.rejected_transactions(validated)
    assert sorted(r["tx_id"] for r in valid.collect()) == [0, 3]
    assert sorted(r["tx_id"] for r in rejected.collect()) == [1, 2]
    assert valid.where("tx_id = 0").first()["id"] == " C 1 "
    assert rejected.columns == ["tx_id", "institution_id", "reject_field", "reject_reason"]
    summary = {(r["reject_field"], r["rejects"]) for r in va.reject_summary(validated).collect()}
    assert summary == {("id", 1), ("amount", 1)}
