"""Nothing gets lost or changed without a mark."""

from __future__ import annotations

import json

import pytest

from pseudosignal.operators import signals as ps
from pseudosignal.operators.admission import admission_control
from pseudosignal.operators.audit import pii_leak_audit
from pseudosignal.operators.matching import within_institution
from pseudosignal.sources import decode_transactions, read_lines, read_signals, write_signals
from pseudosignal.streaming import read_output, start_ingest, untimed_rows, windowed_rollup

VALID = '"name":"n","account":"a","amount":1,"timestamp":"2026-01-15T14:07:33Z"'
NESTED = '"x":{"a":1,"a":2},'


@pytest.mark.parametrize("operator", [
    ps.identity_mosaics, ps.destination_mosaics, ps.salted_hashes, ps.near_threshold_flags,
])
def test_rows_of_unknown_institutions_stay(transactions, ring, operator):
    rows = operator(transactions({}, {"institution_id": "NOBODY"}), ring).collect()
    known, unknown = sorted(rows, key=lambda r: r["tx_id"])
    assert known["reject_reason"] is None
    assert unknown["reject_reason"] == ps.UNKNOWN_INSTITUTION
    assert all(v is None for k, v in unknown.asDict().items() if k not in ("tx_id", "reject_reason"))


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_unlisted_lines_are_never_accepted_leniently(spark, allowed):
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key)
    spark.conf.set(key, allowed)
    try:
        lines = [
            f'{{"id":5,{NESTED}{VALID}}}',
            f'{{"id":"i","device_id":true,{NESTED}{VALID}}}',
            f'{{"ID":"i",{NESTED}{VALID}}}',
            f'{{"id":"i",{NESTED}{VALID}}}',
        ]
        rows = decode_transactions(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    finally:
        spark.conf.set(key, before)
    assert [r["decode_error"] for r in rows[:2]] == ["invalid JSON"] * 2
    # The third can be judged only if its entries can be listed.
    assert (rows[2]["id"], rows[2]["decode_error"]) in (
        [("i", None)] if allowed == "true" else [(None, "invalid JSON")]
    )
    assert (rows[3]["id"], rows[3]["decode_error"]) == ("i", None)


@pytest.mark.parametrize("institution", ["007", "1e3", "2026-01-01"])
def test_institutions_in_folder_names_stay_text(spark, tmp_path, institution):
    folder = tmp_path / f"institution_id={institution}"
    folder.mkdir()
    (folder / "a.txt").write_text(json.dumps({"id": "x"}) + "\n")
    rows = read_lines(spark, str(tmp_path)).collect()
    assert [r["institution_id"] for r in rows] == [institution]


def test_signal_table_comes_back_as_it_was(spark, transactions, ring, tmp_path):
    signals, _ = ps.pseudonymise(transactions({}, {"id": "b"}), ring)
    signals = signals.selectExpr("'007' as institution_id", *signals.columns[1:])
    write_signals(signals, str(tmp_path / "s"))
    back = read_signals(spark, str(tmp_path / "s"))
    assert back.drop("bucket_date").schema.simpleString() == signals.schema.simpleString()
    assert sorted(map(str, back.drop("bucket_date").collect())) == sorted(map(str, signals.collect()))


def test_leak_of_escaped_characters_is_found(spark, transactions, ring):
    raw = transactions({"name": 'Tom & "Jerry"', "branch_id": 'branch of Tom & "Jerry"'})
    signals = ps.signals_of(ps.judge(raw, ring), ("tx_id",))
    rows = {r["field"]: r for r in pii_leak_audit(raw, signals).collect()}
    assert (rows["name"]["contained"], rows["name"]["contained_checked"]) == (1, 1)


def test_arrivals_without_institution_are_judged(spark):
    arrivals = spark.sql("select 1L as signal_id, cast(null as string) as institution_id, 1L as seq,"
                         " timestamp'2026-01-01' as enqueued_at")  # fmt: skip
    depth = spark.createDataFrame([], "institution_id string, spool_depth bigint")
    row = admission_control(arrivals, depth, 5).first()
    assert (row["institution_id"], row["admitted"]) == ("BNK_DEFAULT", True)


def test_new_checkpoint_keeps_earlier_output(spark, transactions, ring, tmp_path):
    out = str(tmp_path / "out")
    for number in range(2):
        source = str(tmp_path / f"in{number}")
        transactions({"id": f"c{number}"}).write.parquet(source)
        schema = spark.read.parquet(source).schema
        start_ingest(
            spark.readStream.schema(schema).parquet(source), ring, out,
            str(tmp_path / f"checkpoint{number}"), trigger={"availableNow": True},
        ).awaitTermination()
    assert read_output(spark, out, "signals").count() == 2


def test_signals_without_bucket_are_counted(spark, transactions, ring, tmp_path):
    signals, _ = ps.pseudonymise(transactions({}, {"id": "b"}), ring)
    source = str(tmp_path / "signals")
    signals.selectExpr(
        *[c if c != "timestamp" else "'TIME_UNKNOWN' as timestamp" for c in signals.columns]
    ).unionByName(signals).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = (
        windowed_rollup(stream).writeStream.format("memory").queryName("untimed")
        .outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert untimed_rows(query) == 2


def test_within_institution_sorts_nothing(transactions, ring):
    signals, _ = ps.pseudonymise(transactions({}, {}), ring)
    plan = within_institution(signals)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
