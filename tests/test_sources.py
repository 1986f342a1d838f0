"""Strict decoding, table sources and sinks."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pseudosignal.operators import signals as ps
from pseudosignal.operators import validate as va
from pseudosignal.schema import RAW_FIELDS, RAW_SCHEMA
from pseudosignal.sources import (
    conform,
    decode_transactions,
    read_lines,
    read_transactions,
    shared_folder,
    write_rejects,
    write_signals,
    write_wire_text,
)

GOOD = {"id": "C", "name": "J", "account": "A", "amount": 1, "timestamp": "2026-01-15T14:07:33Z"}


def text(**changes) -> str:
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if v is not ...})


def decode(spark, lines, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    rows = decode_transactions(df, **options).orderBy("n").collect()
    assert len(rows) == len(lines)
    return rows


GOOD_TEXT = text()
BODY = GOOD_TEXT[1:]

MALFORMED = {
    "not json": "hello",
    "empty": "",
    "blank": "   ",
    "bare number": "5",
    "bare string": '"x"',
    "array": f"[{GOOD_TEXT}]",
    "truncated": GOOD_TEXT[:-1],
    "trailing comma": GOOD_TEXT[:-1] + ",}",
    "single quotes": GOOD_TEXT.replace('"', "'"),
    "string amount": text(amount="lots"),
    "quoted amount": text(amount="5"),
    "quoted nan": text(amount="NaN"),
    "bare nan": GOOD_TEXT.replace('"amount": 1', '"amount": NaN'),
    "leading zero": GOOD_TEXT.replace('"amount": 1', '"amount": 01'),
    "overflow": GOOD_TEXT.replace('"amount": 1', '"amount": 1e400'),
    "negative overflow": GOOD_TEXT.replace('"amount": 1', '"amount": -1e400'),
    "true amount": text(amount=True),
    "object amount": text(amount={"v": 1}),
    "number id": text(id=5),
    "bool id": text(id=True),
    "object id": text(id={"x": 1}),
    "array id": text(id=["x"]),
    "number device": text(device_id=7),
    "string latitude": text(latitude="6.4"),
    "wrong type, then right": '{"id":5,' + BODY,
    "right, then wrong type": GOOD_TEXT[:-1] + ',"id":5}',
    "wrong type in another case": GOOD_TEXT[:-1] + ',"Device_ID":5}',
    "wrong type behind an escape": GOOD_TEXT[:-1] + ',"\\u0049d":5}',
    "control character": GOOD_TEXT.replace("2026", "20\t26"),
    "bad unknown field": GOOD_TEXT[:-1] + ',"x":{bad}}',
}


def test_malformed_documents(spark):
    rows = decode(spark, list(MALFORMED.values()))
    wrong = [n for n, r in zip(MALFORMED, rows, strict=True) if r["decode_error"] != "invalid JSON"]
    assert wrong == []
    assert all(r[f] is None for r in rows for f in RAW_FIELDS)


def test_accepted_documents(spark):
    cases = {
        GOOD_TEXT: {},
        GOOD_TEXT + " trailing text": {},
        GOOD_TEXT + "}": {},
        "  " + GOOD_TEXT: {},
        '{"ID":"z",' + BODY.replace('"id": "C", ', ""): {"id": "z"},
        '{"Id":"first",' + BODY: {},
        '{"id":"first",' + BODY: {},
        GOOD_TEXT[:-1] + ',"ID":"last"}': {"id": "last"},
        GOOD_TEXT[:-1] + ',"id":null}': {},
        GOOD_TEXT[:-1] + ',"AMOUNT":null}': {},
        GOOD_TEXT[:-1] + ',"latitude":1.5,"latitude":null}': {"latitude": None},
        GOOD_TEXT[:-1] + ',"latitude":null,"latitude":1.5}': {"latitude": 1.5},
        GOOD_TEXT[:-1] + ',"device_id":null,"longitude":null}': {},
        GOOD_TEXT[:-1] + ',"\\u0064evice_id":"d"}': {"device_id": "d"},
        GOOD_TEXT[:-1] + ',"\\u0044EVICE_ID":"d"}': {"device_id": "d"},
        GOOD_TEXT[:-1] + ',"i\\u017f":1,"branch_id":"b"}': {"branch_id": "b"},
        GOOD_TEXT[:-1] + ',"device_id_haſh":"h"}': {"device_id_hash": "h"},
        GOOD_TEXT[:-1] + ',"unknown":{"id":5,"amount":"x"},"list":[1,{"name":2}]}': {},
        text(name='say "amount": "lots"'): {"name": 'say "amount": "lots"'},
        text(name="café \U0001f600"): {"name": "café \U0001f600"},
        json.dumps({**GOOD, "name": "café"}, ensure_ascii=False): {"name": "café"},
        text(amount=1.25e3): {"amount": 1250.0},
        GOOD_TEXT.replace('"amount": 1', '"amount" : 1E2'): {"amount": 100.0},
        GOOD_TEXT.replace('"amount": 1', '"amount": 123456789012345678901234567890.5'): {
            "amount": 123456789012345678901234567890.5
        },
        GOOD_TEXT.replace('"amount": 1', '"amount": 1e-400'): {"amount": 0.0},
        "{}": {k: None for k in GOOD},
        "null": {k: None for k in GOOD},
        "null and more": {k: None for k in GOOD},
    }
    rows = decode(spark, list(cases))
    for (line, changes), row in zip(cases.items(), rows, strict=True):
        want = {**dict.fromkeys(RAW_FIELDS), **GOOD, **changes}
        assert row["decode_error"] is None, line
        assert {f: row[f] for f in RAW_FIELDS} == want, line


def test_reject_cases_of_decoding_and_validation(spark):
    lines = [
        "hello", text(id=...), text(id=None), text(id=""), text(amount=None), text(amount="lots"),
        text(timestamp="01/15/2026"), text(latitude=6.4), "null",
        text(latitude=6.4541, longitude=3.3947, amount=250.5),
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "tx_id int, value string")
    validated = va.validate_transactions(decode_transactions(df)).orderBy("tx_id")
    assert [r["reject_field"] for r in validated.collect()] == [
        "payload", "id", "id", "id", "amount", "payload", "timestamp", "latitude/longitude", "id", None,
    ]


def test_size_limit(spark):
    limit = len(GOOD_TEXT) + 10
    exact = GOOD_TEXT + " " * 10
    lines = [exact, exact + " " * 50, " " * 11 + GOOD_TEXT, "x" * (limit + 1), GOOD_TEXT + "é" * 40]
    errors = [r["decode_error"] for r in decode(spark, lines, max_bytes=limit)]
    assert errors == [None, None, "oversize", "oversize", None]


def test_invalid_utf8_is_replaced_not_rejected(spark):
    df = spark.sql("select 1 as n, cast(unhex(hex('%s') || 'FF' || hex('%s')) as string) as value"
                   % (GOOD_TEXT[: GOOD_TEXT.index('"J"') + 1], GOOD_TEXT[GOOD_TEXT.index('"J"') + 1 :]))
    row = decode_transactions(df).first()
    assert row["decode_error"] is None
    assert row["name"] == "�J"


def test_filters_do_not_multiply_the_parsing(spark):
    df = spark.createDataFrame([(GOOD_TEXT,)], "value string")
    validated = va.validate_transactions(decode_transactions(df)).where("reject_field is null")
    plan = validated._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 2


def test_lines_from_partitioned_folders(spark, tmp_path):
    for bank in ("BNK_A", "BNK_B"):
        folder = tmp_path / f"institution_id={bank}"
        folder.mkdir()
        (folder / "part.json").write_text(GOOD_TEXT + "\nhello\n", encoding="utf-8")
    decoded = decode_transactions(read_lines(spark, str(tmp_path)))
    rows = {(r["institution_id"], r["decode_error"]) for r in decoded.collect()}
    assert rows == {(b, e) for b in ("BNK_A", "BNK_B") for e in (None, "invalid JSON")}


def test_conform(spark):
    df = spark.createDataFrame(
        [("C", "J", "A", Decimal("12.50"), datetime(2026, 1, 15, 14, 7, 33, tzinfo=timezone.utc), "6.5", 1)],
        "id string, name string, account string, amount decimal(10,2), timestamp timestamp,"
        " latitude string, extra int",
    )
    out = conform(df)
    assert out.columns == RAW_SCHEMA.fieldNames()
    assert [f.dataType for f in out.schema] == [f.dataType for f in RAW_SCHEMA]
    row = out.first()
    assert (row["amount"], row["timestamp"], row["latitude"], row["longitude"]) == (
        12.5, "2026-01-15T14:07:33Z", 6.5, None,
    )
    with pytest.raises(ValueError, match="account"):
        conform(df.drop("account"))


def test_read_transactions_prunes_and_pushes_down(spark, transactions, tmp_path):
    path = str(tmp_path / "raw")
    transactions({}, {"amount": 5.0}).write.parquet(path)
    df = read_transactions(spark, path).where("amount > 50").select("tx_id", "amount")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(amount,50.0)" in plan
    assert "ReadSchema: struct<tx_id:bigint,amount:double>" in plan
    assert df.count() == 1


def test_sinks(spark, transactions, ring, tmp_path):
    signals, rejects = ps.pseudonymise(
        transactions({}, {"institution_id": "BNK_A", "timestamp": "2026-01-16T00:00:00Z"}, {"id": ""}), ring
    )
    write_signals(signals, str(tmp_path / "signals"))
    write_rejects(rejects, str(tmp_path / "rejects"))
    write_wire_text(ps.payloads(signals), str(tmp_path / "wire"))
    assert os.path.isdir(tmp_path / "signals/institution_id=BNK_A/bucket_date=2026-01-16")
    back = spark.read.parquet(str(tmp_path / "signals"))
    assert sorted(r[0] for r in back.select("identity_mosaic").collect()) == sorted(
        r[0] for r in signals.select("identity_mosaic").collect()
    )
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1
    wire = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "wire")).collect()]
    assert {w["institution_id"] for w in wire} == {"BNK", "BNK_A"}


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(f"{base}/x-")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_decoding_uses_no_python(spark):
    df = spark.createDataFrame([(GOOD_TEXT,)], "value string").select(F.upper("value").alias("value"))
    plan = decode_transactions(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
