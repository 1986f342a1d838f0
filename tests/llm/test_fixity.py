from __future__ import annotations

from pseudosignal.llm import fixity

RECORDS = "file string, offset bigint, digest string, node string, n bigint"


def records(files: int, each: int) -> list:
    return [(f"f{f}", 700 * i, f"d{f}-{i}", "x", 9) for f in range(files) for i in range(each)]


def found(spark, one, other):
    frames = [spark.createDataFrame(x, RECORDS) for x in (one, other)]
    return sorted((tuple(r) for r in fixity.audit(*frames).collect()), key=str)


def test_faults_are_located(spark):
    one = records(5, 3000)
    other = [r for r in one if r[:2] != ("f1", 700 * 2999)]
    other = [(f, o, "bad" if (f, o) == ("f3", 70000) else d, x, n) for f, o, d, x, n in other]
    other.append(("f4", 5, "new", "x", 9))
    other.append(("g", 0, "file", "x", 9))
    assert found(spark, one, other) == [
        ("f1", 2099300, "missing", "d1-2999", None),
        ("f3", 70000, "corrupt", "d3-100", "bad"),
        ("f4", 5, "extra", None, "new"),
        ("g", 0, "extra", None, "file"),
    ]


def test_equal_and_empty_replicas(spark):
    one = records(2, 50)
    assert found(spark, one, list(reversed(one))) == []
    assert found(spark, [], []) == []
    assert found(spark, one[:1], []) == [("f0", 0, "missing", "d0-0", None)]


def test_nulls_and_repeats(spark):
    one = [(None, None, None, None, None), ("f", 0, "a", "x", 1), ("f", 0, "a", "x", 1)]
    assert found(spark, one, one) == []
    assert found(spark, one, one[:2]) == [("f", 0, "corrupt", "a", "a")]
    assert found(spark, one, one[1:]) == [("", 0, "missing", "", None)]


def test_only_branches_that_differ_are_read(spark, monkeypatch):
    """One corrupt record opens one leaf."""
    one = spark.createDataFrame(records(3, 2000), RECORDS)
    bad = one.selectExpr("file", "offset", "if(file = 'f1' and offset = 0, 'bad', digest) as digest")
    seen = []
    inner = fixity._records
    monkeypatch.setattr(
        fixity, "_records", lambda a, b, ranges: seen.append(ranges.count()) or inner(a, b, ranges)
    )
    assert fixity.audit(one, bad).count() == 1
    assert seen == [1]


def test_archive_lays_pages_out(spark):
    pages = spark.createDataFrame(
        [(0, "u", "é" * 10), (1, None, "b"), (1001, "v", None), (None, "w", "x")],
        "page_id bigint, url string, html string",
    )
    rows = {r["page_id"]: r for r in fixity.archive(pages).collect()}
    assert rows[0]["offset"] == 0 and rows[1]["offset"] == 128 + 1 + 20
    assert (rows[0]["file"], rows[1001]["file"]) == ("warc-0", "warc-1")
    assert len({r["digest"] for r in rows.values()}) == 4
    assert fixity.archive(pages.limit(0)).count() == 0
