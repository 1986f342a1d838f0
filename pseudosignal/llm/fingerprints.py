"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

A fingerprint has 128 bits, written as 32 hex digits: every pair of neighbouring words is
hashed, its weight (1 + log2 of its count) is a vote for or against each bit, and the sign wins.

Fingerprints within radius r agree in one of r + 1 blocks at least. So there are r + 1 tables,
each with another block in front; in a table, fingerprints with the same front block meet. A
pair is counted in the first table where it meets. A front block that very many fingerprints
share is split: its members are dealt into parts of at most ``PART`` fingerprints, and every two
parts meet in a task of their own. Only counts, or the pairs asked for, leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudosignal.llm.common import bounded_batches, stored, table
from pseudosignal.llm.simhash import BITS, simhash

RADIUS = 3
PART = 4096
# Fingerprints that a task compares at a time, groups kept whole.
ROWS_AT_ONCE = 1 << 15

_NAMES = {
    "doc_id": T.LongType(),
    "n_chars": T.LongType(),
    "edited_sha256": T.StringType(),
    "fingerprint": T.StringType(),
    "edited_fingerprint": T.StringType(),
    "near_edited": T.DoubleType(),
    "near_next": T.DoubleType(),
}
_RESULT = T.StructType([T.StructField(name, kind) for name, kind in _NAMES.items()])
# Results, and the first and last document of each range, with their texts.
_MARKED = T.StructType(
    [
        *_RESULT.fields,
        T.StructField("kind", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
_DONE, _HEAD, _TAIL = 0, 1, 2


def likeness(a: str, b: str) -> float:
    """Cosine of the documents' term vectors as their fingerprints estimate it, at least 0."""
    from math import cos, pi

    return max(0.0, cos(pi * (int(a, 16) ^ int(b, 16)).bit_count() / BITS))


def _row(doc_id, text: str, own: str, after: str, print_after: str) -> tuple:
    """A result row, of a text and the next one."""
    moved = len(text) // 3
    edited = (text[: len(text) - moved] + after[:moved]).encode()
    print_edited = simhash(edited).hex()
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited).hexdigest(),
        own,
        print_edited,
        likeness(own, print_edited),
        likeness(own, print_after),
    )


def _arrow(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, schema=fields)


def _along(batches) -> Iterator:
    """Result rows of a sorted range, and its first and last row, which other ranges need."""
    part = TaskContext.get().partitionId()
    held = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            own = simhash(text.encode()).hex()
            if held is None:
                rows.append((doc_id, None, None, own, None, None, None, _HEAD, part, text))
            else:
                rows.append((*_row(*held, text, own), _DONE, part, None))
            held = (doc_id, text, own)
        yield _arrow(rows, _MARKED)
    if held is not None:
        doc_id, text, own = held
        last = (doc_id, None, None, own, None, None, None, _TAIL, part, text)
        yield _arrow([last], _MARKED)


def _across(batches) -> Iterator:
    """Result rows of the last documents of ranges, each with the first of the next range."""
    for batch in batches:
        rows = [
            _row(r["doc_id"], r["text"], r["own"], r["after"], r["print_after"])
            for r in batch.to_pylist()
        ]
        yield _arrow(rows, _RESULT)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, and of each text edited by the next document's.

    The next document is that of the next smaller doc_id, after the last one the first; NULL ids
    come last, and rows with equal ids go by a digest of their text. The last third of a text
    gives way to as much of the beginning of the next. A NULL text counts as empty; empty texts
    have the fingerprint of all zeros. A single document is its own next. Repeated rows give
    repeated results; an empty table none. Only doc_id and text are read.

    The texts are sorted into ranges once; in a range a row meets the next one as it goes by, and
    the ends of ranges, two documents for each, meet in a join.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie"), F.col("_salt")]
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_tie"),
        # Equal rows are dealt over several ranges.
        F.rand(0).alias("_salt"),
    )
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with bounded_batches(spark):
        found = stored(ranged.mapInArrow(_along, _MARKED), "fingerprints")
    heads = found.where(F.col("kind") == _HEAD)
    # One number for each range.
    places = heads.select("part").withColumns(
        {
            "_next": F.lead("part").over(Window.orderBy("part")),
            "_first": F.min("part").over(Window.partitionBy(F.lit(1))),
        }
    )
    after = heads.select(
        F.col("part").alias("_next"),
        F.col("text").alias("after"),
        F.col("fingerprint").alias("print_after"),
    )
    tails = (
        found.where(F.col("kind") == _TAIL)
        .select("doc_id", "text", F.col("fingerprint").alias("own"), "part")
        .join(places.select("part", F.coalesce("_next", "_first").alias("_next")), "part")
        .join(after, "_next")
        .select("doc_id", "text", "own", "after", "print_after")
    )
    inner = found.where(F.col("kind") == _DONE).select(*_NAMES)
    return inner.unionByName(tails.mapInArrow(_across, _RESULT))


def _front(table_number: int, radius: int) -> Column:
    digits = BITS // 4 // (radius + 1)
    return F.substring("fingerprint", table_number * digits + 1, digits)


def _met(prints: DataFrame, radius: int) -> DataFrame:
    """Rows (meeting, fingerprint, n, front, side): one meeting is one task's work."""
    if radius < 0 or (BITS // 4) % (radius + 1):
        raise ValueError(f"radius + 1 must divide {BITS // 4}")
    tables = F.array(
        *[F.struct(F.lit(t).alias("t"), _front(t, radius).alias("front")) for t in range(radius + 1)]
    )
    members = prints.select("fingerprint", "n", F.explode(tables).alias("at")).select(
        "fingerprint", "n", "at.t", "at.front"
    )
    shared = stored(
        members.groupBy("t", "front").agg(F.count("*").alias("size")).where("size > 1"),
        "fingerprint-buckets",
    )
    parts = F.expr(f"(size + {PART - 1}) div {PART}")
    met = members.join(shared, ["t", "front"]).withColumn("parts", parts)
    met = met.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("parts")))
    # With one part this is a single meeting; with more, every part meets itself and each other.
    return met.select(
        "fingerprint",
        "n",
        "t",
        "front",
        "own",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"),
    ).select(
        "fingerprint",
        "n",
        "t",
        F.xxhash64(
            "t", "front", F.least("own", "other"), F.greatest("own", "other")
        ).alias("meeting"),
        "front",
        (F.col("own") > F.col("other")).alias("second"),
        (F.col("own") == F.col("other")).alias("same"),
    )


def _search(prints: DataFrame, radius: int, pairs: bool) -> DataFrame:
    def compare(rows):
        """Rows sorted by meeting; compares each with those behind it in the same meeting."""
        import numpy as np
        import pandas as pd

        rows = rows.reset_index(drop=True)
        data = np.frombuffer(bytes.fromhex("".join(rows["fingerprint"])), np.uint8)
        words = data.view(np.uint64).reshape(len(rows), -1)
        named = rows[["meeting", "t", "front"]]
        group = (named != named.shift()).any(axis=1).cumsum().to_numpy()
        t, same, second = (rows[c].to_numpy() for c in ("t", "same", "second"))
        n, near, found = rows["n"].to_numpy(), np.zeros(len(rows), np.int64), []
        at = np.arange(len(rows))
        for step in range(1, len(rows)):
            at = at[at + step < len(rows)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            # In a meeting of two parts only rows of different parts are compared.
            one = at[same[at] | (second[at] != second[at + step])]
            apart = words[one] ^ words[one + step]
            distance = np.bitwise_count(apart).sum(axis=1)
            close = distance <= radius
            one, apart, distance = one[close], apart[close], distance[close]
            if not len(one):
                continue
            octets = apart.view(np.uint8).reshape(len(one), -1)
            nibbles = np.stack([octets >> 4, octets & 15], axis=2).reshape(len(one), radius + 1, -1)
            # The first block in which the two agree.
            here = np.argmin(nibbles.any(axis=2), axis=1) == t[one]
            one, distance = one[here], distance[here]
            np.add.at(near, one, n[one + step])
            np.add.at(near, one + step, n[one])
            if pairs:
                a, b = (rows["fingerprint"].to_numpy()[x] for x in (one, one + step))
                ends = {"a": np.minimum(a, b), "b": np.maximum(a, b)}
                found.append(pd.DataFrame({**ends, "distance": distance.astype(np.int32)}))
        if pairs:
            return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "distance": []})
        out = pd.DataFrame({"fingerprint": rows["fingerprint"], "near": near})
        return out[out["near"] > 0]

    def run(frames):
        import pandas as pd

        waiting = []
        for frame in frames:
            waiting.append(frame)
            if sum(map(len, waiting)) < ROWS_AT_ONCE:
                continue
            rows = pd.concat(waiting)
            last = rows["meeting"] == rows["meeting"].iloc[-1]
            if not last.all():
                yield compare(rows[~last])
                rows = rows[last]
            waiting = [rows]
        if waiting:
            yield compare(pd.concat(waiting))

    met = _met(prints, radius).repartition("meeting")
    met = met.sortWithinPartitions("meeting", "t", "front")
    schema = "a string, b string, distance int" if pairs else "fingerprint string, near bigint"
    return met.mapInPandas(run, schema)


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) of all distinct fingerprints of the column ``fingerprint`` within the
    radius, a < b. radius + 1 must divide 32. NULL fingerprints are in no pair."""
    distinct = prints.where("fingerprint is not null").select("fingerprint").distinct()
    distinct = stored(distinct.withColumn("n", F.lit(1).cast("bigint")), "fingerprints-distinct")
    return _search(distinct, radius, pairs=True)


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near): for each distinct fingerprint the number of other rows whose
    fingerprint is within the radius, those with the same fingerprint included."""
    counted = stored(
        prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n")),
        "fingerprints-distinct",
    )
    others = _search(counted, radius, pairs=False)
    own = counted.select("fingerprint", (F.col("n") - 1).alias("near"))
    both = own.unionByName(others).groupBy("fingerprint")
    return both.agg(F.sum("near").alias("n_near"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edited_fingerprints`` of all documents, and ``n_near``: how many other documents have a
    fingerprint within ``RADIUS``. Cases as there."""
    found = stored(edited_fingerprints(table(spark, sf_dir, "documents")), "fingerprints-edited")
    return found.join(stored(near_counts(found), "fingerprints-near"), "fingerprint", "left").select(
        *found.columns, "n_near"
    )
