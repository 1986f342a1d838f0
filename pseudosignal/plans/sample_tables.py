"""Transactions, delivery tables and keys derived from the order and customer tables.

The test data holds no transactions, so every query starts from these
deterministic views. They work on streaming orders as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.operators.keys import InstitutionKeys, KeyRing, key_ring
from pseudosignal.schema import RAW_FIELDS

SAMPLE_INSTITUTIONS = 5
SAMPLE_PEPPER = "shared_pepper"
MAX_LINE = 1 << 20


def sample_keys() -> list[InstitutionKeys]:
    return [
        InstitutionKeys(
            institution_id=f"BNK_{i}",
            bank_salt=f"sample_salt_of_institution_{i}_padded",
            regional_pepper=SAMPLE_PEPPER,
            hmac_secret=f"sample_signing_secret_{i}",
        )
        for i in range(SAMPLE_INSTITUTIONS)
    ]


def sample_ring(spark: SparkSession) -> KeyRing:
    return key_ring(spark, sample_keys())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Columns of a sample transaction. k is the order key, c the customer key, bad = k % 50 picks
# the rule to break, cp is the counterparty and own / other are national identifiers.
_BASE = {
    "k": "o_orderkey",
    "c": "o_custkey",
    "bad": "o_orderkey % 50",
    "cp": "(o_orderkey * 31 + 7) % 150",
    "own": "lpad(cast(22000000000L + o_custkey as string), 11, '0')",
    "local_time": (
        "date_format(timestampadd(MINUTE, cast(o_orderkey % 1440 as int), o_orderdate),"
        " \"yyyy-MM-dd'T'HH:mm:ss\")"
    ),
    "c_name": "c_name",
    "c_nationkey": "c_nationkey",
    "o_totalprice": "o_totalprice",
}
_TRANSACTION = {
    "tx_id": "k",
    "institution_id": "concat('BNK_', k % 5)",
    "id": "if(bad = 1, '   ', concat('CUST-', c))",
    "name": (
        "case when bad = 2 then '' when k % 2 = 0 then concat('  ', lower(c_name), ' ')"
        " else c_name end"
    ),
    "national_id": (
        "case when c % 3 = 0 then null when k % 5 = 0 then"
        " concat(substr(own, 1, 4), '-', substr(own, 5, 4), ' ', substr(own, 9, 3)) else own end"
    ),
    "account": "if(bad = 3, '', concat('ACC-', c))",
    "amount": (
        "case when bad = 4 then 0D when bad = 6 then -o_totalprice else o_totalprice / 32D end"
    ),
    "latitude": (
        "case when k % 4 = 0 then null when bad = 7 then 95D"
        " else double((k * 37) % 11521) / 64D - 90D end"
    ),
    "longitude": (
        "case when k % 4 = 0 or bad = 9 then null when bad = 11 then -190D"
        " else double((k * 91) % 23041) / 64D - 180D end"
    ),
    "timestamp": (
        "concat(local_time, case when bad = 13 then '' when k % 3 = 0 then 'Z'"
        " when k % 3 = 1 then '+01:00' else '.250-05:00' end)"
    ),
    "device_id": "if(k % 5 = 0, null, concat('DEV-', c % 100))",
    "device_id_hash": "if(k % 11 = 0, 'prehashed_device', null)",
    "ip": "concat('10.0.', c % 256, '.', k % 256)",
    "ip_hash": "if(k % 13 = 0, 'prehashed_ip', null)",
    "branch_id": "concat('BR-', c_nationkey)",
    "signal_type": "if(k % 7 = 0, '', 'transaction')",
    "endpoint_type": "case k % 3 when 0 then 'ATM' when 1 then 'POS' else 'MOBILE_APP' end",
    "counterparty_id": "if(k % 2 = 0, concat('CUST-', cp), null)",
    "counterparty_national_id": (
        "if(k % 4 = 0 and cp % 3 <> 0, lpad(cast(22000000000L + cp as string), 11, '0'), null)"
    ),
}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{rule} as `{name}`" for name, rule in columns.items()])


def raw_transactions(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One transaction per order. Some break a rule on purpose."""
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return _select(_select(joined, _BASE), _TRANSACTION)


def raw_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_transactions(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


# How some lines are written, by form = tx_id % 40; all others are plain.
_FORMS = {
    21: "'hello'",
    22: """replace(plain, '"amount":', '"amount":"lots","was":')""",
    23: """replace(plain, '"id":', '"ID":')""",
    24: "concat(plain, ' trailing text')",
    25: """concat('{"id":"replaced","unknown":{"deep":[1,2]},', substr(plain, 2))""",
    26: """replace(plain, '"', "'")""",
    27: """concat('{"ID":5,', substr(plain, 2))""",
    28: "concat('[', plain, ']')",
    29: "'null'",
    30: "''",
    31: r"""replace(plain, '"account":', concat('"', chr(92), 'u0041ccount":'))""",
    32: """concat(substr(plain, 1, length(plain) - 1), ',"name":null,"latitude":null}')""",
    33: """concat('{"device_id":true,', substr(plain, 2))""",
    34: "substr(plain, 1, 40)",
}


def transaction_lines(transactions: DataFrame) -> DataFrame:
    """The transactions as JSON lines, some of them malformed or written unusually."""
    cases = " ".join(f"when {form} then {rule}" for form, rule in _FORMS.items())
    line = (
        f"case when tx_id % 5000 = 17 then concat(repeat(' ', {MAX_LINE}), plain)"
        f" when tx_id % 5000 = 18 then concat(plain, repeat(' ', {MAX_LINE}))"
        f" else case tx_id % 40 {cases} else plain end end"
    )
    written = transactions.select(
        "tx_id", "institution_id", F.to_json(F.struct(*RAW_FIELDS)).alias("plain")
    )
    return written.selectExpr("tx_id", "institution_id", f"{line} as value")


def outbox(signals: DataFrame, payload: Column) -> DataFrame:
    """Queue table of signals: submission order is (enqueued_at, seq) per institution.

    Many signals share an instant, so the sequence number matters too.
    """
    return signals.select(
        F.col("tx_id").alias("signal_id"),
        "institution_id",
        F.col("tx_id").alias("seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("tx_id") * 7919) % 3000).alias(
            "enqueued_at"
        ),
        payload.alias("payload"),
    )


def attempts(transactions: DataFrame) -> DataFrame:
    """Delivery attempts by ``tx_id % 6``; every sixth transaction has none."""
    codes = (
        "case tx_id % 6 when 0 then array(201) when 1 then array(500, 200) when 2 then array(401)"
        " when 3 then array(503, 429, 503) when 4 then array(null, 200)"
        " else cast(array() as array<int>) end"
    )
    return transactions.selectExpr(
        "tx_id", "institution_id", f"posexplode({codes}) as (pos, status_code)"
    ).selectExpr(
        "tx_id as signal_id",
        "institution_id",
        "pos + 1 as attempt_no",
        "timestamp_seconds(1700000000 + tx_id * 60 + pos * 7) as attempted_at",
        "status_code",
        "10 + tx_id % 50 as elapsed_ms",
    )
