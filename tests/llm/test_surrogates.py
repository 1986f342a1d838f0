from __future__ import annotations

import pytest

from pseudosignal.llm import surrogates

from .conftest import EDGES

KEY = "a key"


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
    return total % 10 == 0


@pytest.fixture(scope="module")
def replaced(docs_of):
    """Entities of texts, by text, with their surrogates."""

    def run(texts, key=KEY):
        rows = surrogates.replace(docs_of(list(enumerate(texts))), key).collect()
        return {
            r["row"]["doc_id"]: [
                (surrogates.KINDS[e["kind"]], e["entity"], e["surrogate"]) for e in r["entities"]
            ]
            for r in rows
        }

    return run


TEXT = (
    "Ask Ann.Lee+7@Mail3.example.com or ann.lee+7@mail3.example.com, call +1 (456) 555-2186, "
    "card 4449909768109707 and 4539-5787-6362-1486, not 4449909768109708, from 192.168.7.254, "
    "id 078-05-1120. Frau Müller met Mr. John Smith; г-н Иванов and κα Παππά came."
)


def test_kinds_and_formats(replaced):
    found = replaced([TEXT])[0]
    assert [(k, e) for k, e, _ in found] == [
        ("email", "Ann.Lee+7@Mail3.example.com"),
        ("email", "ann.lee+7@mail3.example.com"),
        ("phone", "+1 (456) 555-2186"),
        ("card", "4449909768109707"),
        ("card", "4539-5787-6362-1486"),
        ("ip", "192.168.7.254"),
        ("ssn", "078-05-1120"),
        ("name", "Frau Müller"),
        ("name", "Mr. John Smith"),
        ("name", "г-н Иванов"),
        ("name", "κα Παππά"),
    ]
    made = {e: s for _, e, s in found}
    for _, entity, new in found[:7]:
        assert new != entity
        if "." not in entity or "@" in entity:
            shape = lambda t: [(c.isdigit(), c.isupper(), c.islower(), c if not c.isalnum() else "") for c in t]
            assert shape(new) == shape(entity)
    assert luhn(made["4449909768109707"]) and luhn(made["4539-5787-6362-1486"])
    assert made["+1 (456) 555-2186"].startswith("+1 (")
    assert all(0 <= int(o) <= 255 for o in made["192.168.7.254"].split("."))
    one, two = (made[e] for e in list(made)[:2])
    assert one.lower() == two and one.endswith(".com") and one[0].isupper()
    assert made["Frau Müller"].startswith("Frau ") and made["Frau Müller"][-1] == "a"
    assert len(made["Mr. John Smith"].split()) == 3
    assert all("а" <= c.lower() <= "я" for c in made["г-н Иванов"].split()[1])
    assert made["κα Παππά"].split()[1][0].isupper()


def test_same_entity_same_surrogate_and_key_matters(replaced):
    texts = ["from 10.0.0.1", "to 10.0.0.1 and a@b.org", "a@b.org"]
    one, other = replaced(texts), replaced(texts, "another key")
    assert one[0][0] == one[1][0] and one[1][1] == one[2][0]
    assert one[0][0][2] != other[0][0][2]


def test_distinct_entities_stay_distinct(replaced):
    texts = [f"10.0.{i // 250}.{i % 250} u{i}@d{i % 7}.org (555) 555-{1000 + i}" for i in range(1500)]
    texts += [f"Mr A{chr(97 + i % 26)}{chr(97 + i // 26)} B{chr(97 + i % 23)}" for i in range(500)]
    every = [x for found in replaced(texts).values() for x in found]
    for kind in ("ip", "email", "phone", "name"):
        pairs = {(e, s) for k, e, s in every if k == kind}
        assert len(pairs) >= 500
        assert len({e for e, _ in pairs}) == len({s for _, s in pairs}) == len(pairs)


def test_names_that_collide_get_another_attempt(docs_of, monkeypatch):
    inner = surrogates._name
    monkeypatch.setattr(
        surrogates,
        "_name",
        lambda e, key, attempt: inner(e, key, attempt) if attempt else surrogates.F.lit("Mr Same"),
    )
    found = surrogates.detect(docs_of([(1, "Mr Abel"), (2, "Mr Cain")]))
    assert surrogates._settled_attempt(surrogates._keyed(found, KEY)) == 1


def test_text_is_put_together_again(docs_of):
    row = surrogates.anonymise(docs_of([(1, "\U0001f600 é 10.0.0.1, a@b.org")]), KEY).first()
    assert row["spans"] == "ip:4:12,email:14:21" and (row["n_ip"], row["n_email"]) == (1, 1)
    new = row["text"]
    assert new.startswith("\U0001f600 é ") and ", " in new and new.endswith(".org")
    assert "10.0.0.1" not in new and "a@b" not in new


def test_clean_texts_are_left_alone(docs_of, edges):
    rows = surrogates.anonymise(edges, KEY).collect()
    assert len(rows) == len(EDGES)
    texts = {(i, t) for i, t in EDGES}
    assert {(r["doc_id"], r["text"]) for r in rows} == texts
    assert {r["spans"] for r in rows} == {""}
    assert surrogates.anonymise(docs_of([]), KEY).count() == 0


def test_plan_has_no_python(docs_of):
    plan = surrogates.anonymise(docs_of([(1, TEXT)]), KEY)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_key_is_in_no_plan_and_names_are_in_no_file(spark, docs_of):
    key = "a-key-that-must-not-show"
    docs = docs_of([(1, "Write to Mr John Example or to jane@real.org, 555-123-4567.")])
    done = surrogates.anonymise(docs, key)
    plan = done._jdf.queryExecution().toString() + done._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")
    )
    assert key not in plan
    folder = spark.conf.get("spark.checkpoint.dir")
    import glob

    for file in glob.glob(f"{folder}/surrogate-marks-*/*.parquet"):
        data = open(file, "rb").read()
        assert b"Example" not in data and key.encode() not in data
    (row,) = done.collect()
    assert "John" not in row["text"] and "jane@real.org" not in row["text"]
