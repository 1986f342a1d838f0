"""Codes of vectors in four parts, with exact integer codebooks and norm-of-sum bounds.

Assigning a part to the nearest of 256 entries needs 256 distances, most of which cannot matter.
So every part keeps, for each of ``GROUPS`` groups of entries, a lower bound of the distance to
all entries of the group but its own, and the round in which that bound was measured. The
codebooks of all rounds are kept. In a later round the bound is lessened by how far an entry of
the group has truly moved since the stamp: the norm of the sum of its moves, which is at most
the sum of their norms, for entries move back and forth. Only groups whose bound
does not exceed the distance to the own entry are measured again, exactly and in integers; then
their bounds get a new stamp. What is skipped is strictly farther away, so codes, ties included,
are those of the plain method.

A round is one pass of tasks over the stored vectors with a broadcast of the codebooks (256
entries a round, whatever the data), and one sum by (part, entry, position) that combines before
the shuffle. The state of a round replaces that of the round before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudosignal.llm.common import discard, stored_at, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
GROUPS = 16
# Rows of labels that are broadcast; beyond, label errors are joined, hot labels salted.
MAX_BROADCAST_LABELS = 100_000
SALTS = 64
# Integers up to this size have exact squared distances in a long, for parts of 512 at most.
LARGEST = 1 << 26
# Up to this size even sums of products are exact in doubles.
EXACT_IN_DOUBLES = 1 << 20


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of x by entries."""
    largest = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if largest <= EXACT_IN_DOUBLES and x.shape[1] <= 2048:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        return d.astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def _groups(entries: int) -> list[np.ndarray]:
    return np.array_split(np.arange(entries), min(GROUPS, max(1, entries)))


def _below(lengths: np.ndarray) -> np.ndarray:
    """As single-precision numbers that are not larger."""
    short = lengths.astype(np.float32)
    return np.where(short > lengths, np.nextafter(short, np.float32(-np.inf)), short)


def moved_since(history: list[np.ndarray], part: int) -> np.ndarray:
    """For each round so far and each group: how far an entry has got from its place then."""
    now, groups = history[-1][part], _groups(history[-1].shape[1])
    out = np.zeros((len(history), len(groups)))
    for stamp, book in enumerate(history):
        away = np.sqrt(((now - book[part]) ** 2).sum(axis=1).astype(np.float64))
        out[stamp] = [away[g].max(initial=0.0) for g in groups]
    # A little more, for the rounding of roots.
    return out * (1 + 1e-9)


def assign_part(
    x: np.ndarray, history: list[np.ndarray], part: int, code: np.ndarray, lower: np.ndarray, stamp: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """New codes and exact squared distances of one part; ``lower`` and ``stamp`` are updated.

    Also the number of distances that were measured. In the first round ``code`` is all zeros
    and the bounds are zeros, which makes every group be measured.
    """
    entries, now = history[-1][part], len(history) - 1
    groups = _groups(len(entries))
    moved = moved_since(history, part)
    old = code.astype(np.int64)
    own = ((x - entries[old]) ** 2).sum(axis=1)
    bound = lower - moved[stamp, np.arange(len(groups))]
    open_ = bound <= np.sqrt(own.astype(np.float64))[:, None] * (1 + 1e-9)
    best, best_code = own.copy(), old.copy()
    measured = []
    for g, members in enumerate(groups):
        rows = np.flatnonzero(open_[:, g])
        d = distances(x[rows], entries[members])
        measured.append((rows, d))
        if not len(rows):
            continue
        at = d.argmin(axis=1)
        low, winner = d[np.arange(len(rows)), at], members[at]
        better = (low < best[rows]) | ((low == best[rows]) & (winner < best_code[rows]))
        best[rows[better]], best_code[rows[better]] = low[better], winner[better]
    for g, members in enumerate(groups):
        rows, d = measured[g]
        if len(rows):
            d = np.where(members[None, :] == best_code[rows][:, None], np.iinfo(np.int64).max, d)
            lower[rows, g] = _below(np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - 1e-9))
            stamp[rows, g] = now
    # An entry that is left counts again for the bound of its group, if that was not measured.
    group_of = np.concatenate([np.full(len(m), g) for g, m in enumerate(groups)])
    left = np.flatnonzero(best_code != old)
    left = left[~open_[left, group_of[old[left]]]]
    g = group_of[old[left]]
    here = np.minimum(bound[left, g], np.sqrt(own[left].astype(np.float64)) * (1 - 1e-9))
    lower[left, g], stamp[left, g] = _below(here), now
    return best_code, best, sum(d.size for _, d in measured) + len(x)


_STATE = [
    T.StructField("code", T.BinaryType()),
    T.StructField("lower", T.BinaryType()),
    T.StructField("stamp", T.BinaryType()),
    T.StructField("error", T.LongType()),
    T.StructField("measured", T.LongType()),
]


def _assigned(state: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """One pass: rows (vec_id, label, v, ..) with the state after assignment to the last codebook."""
    import pyarrow as pa

    first = "code" not in state.columns
    kept = state.select("vec_id", "label", "v") if first else state
    books = kept.sparkSession.sparkContext.broadcast(history)
    schema = T.StructType([*kept.schema.fields[:3], *_STATE])

    def run(batches) -> Iterator:
        history = books.value
        parts, entries, width = history[-1].shape
        groups = len(_groups(entries))
        for batch in batches:
            n = batch.num_rows
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            v = v.astype(np.int64).reshape(n, parts, width)
            if first:
                code = np.zeros((n, parts), np.uint8)
                lower = np.zeros((n, parts, groups), np.float32)
                stamp = np.zeros((n, parts, groups), np.uint8)
            else:
                packed = [b"".join(batch.column(i).to_pylist()) for i in (3, 4, 5)]
                code = np.frombuffer(packed[0], np.uint8).reshape(n, parts).copy()
                lower = np.frombuffer(packed[1], np.float32).reshape(n, parts, groups).copy()
                stamp = np.frombuffer(packed[2], np.uint8).reshape(n, parts, groups).copy()
            error, measured = np.zeros(n, np.int64), 0
            for p in range(parts):
                low, at = lower[:, p].copy(), stamp[:, p].copy()
                code[:, p], d, seen = assign_part(v[:, p], history, p, code[:, p], low, at)
                lower[:, p], stamp[:, p] = low, at
                error, measured = error + d, measured + seen
            columns = [
                *[batch.column(i) for i in range(3)],
                *[pa.array([row.tobytes() for row in a], pa.binary()) for a in (code, lower, stamp)],
                pa.array(error),
                # The pass's measurements, on the first row of the batch.
                pa.array(np.concatenate(([measured], np.zeros(max(0, n - 1), np.int64)))[:n]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def _sums(state: DataFrame, shape: tuple) -> DataFrame:
    """(part, entry, position, total, n) over the vectors of each entry."""
    parts, entries, width = shape

    def run(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.num_rows
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            v = v.reshape(n, parts, width)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], v[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array(np.repeat(p, width).astype(np.int32)),
                "entry": pa.array(np.repeat(e, width).astype(np.int32)),
                "position": pa.array(np.tile(np.arange(width), len(p)).astype(np.int32)),
                "total": pa.array(total[p, e].reshape(-1)),
                "n": pa.array(np.repeat(count[p, e], width)),
            }
        )

    found = state.select("v", "code").mapInArrow(
        run, "part int, entry int, position int, total bigint, n bigint"
    )
    return found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _updated(book: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The next codebook: at most parts x entries x width numbers come to the driver."""
    rows = sums.select(
        "part", "entry", "position", F.expr("(total - pmod(total, n)) div n").alias("mean")
    ).toPandas()
    book = book.copy()
    book[rows["part"], rows["entry"], rows["position"]] = rows["mean"]
    return book


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): floor(1024 x) of vectors that have no null or non-finite component."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    large = F.exists(x, lambda c: F.abs(c) >= LARGEST / SCALE)
    message = f"a component of {LARGEST // SCALE} or more has no exact square"
    v = F.transform(x, lambda c: F.floor(c * SCALE).cast("int"))
    return embeddings.where(x.isNotNull() & ~bad).select(
        "vec_id", "label", F.when(large, F.raise_error(F.lit(message))).otherwise(v).alias("v")
    )


def first_codebook(vectors: DataFrame) -> np.ndarray | None:
    """Entries from the smallest ids: (PARTS, entries, width); None without vectors.

    At most ``ENTRIES`` vectors come to the driver. Vectors with the same id give one entry,
    from the smallest of them; ids are those of vectors as long as that of the smallest id.
    """
    usable = vectors.where(f"vec_id is not null and size(v) > 0 and size(v) % {PARTS} = 0")
    lead = usable.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(1).first()
    if lead is None:
        return None
    width = len(lead["v"])
    same = usable.where(F.size("v") == width)
    ids = [r[0] for r in same.select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    seeds = same.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = sorted(seeds.collect(), key=lambda r: r["vec_id"])
    book = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), PARTS, width // PARTS)
    return book.transpose(1, 0, 2).copy()


def book_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], list[float]]:
    """Codes of all vectors, the codebooks of all rounds, and the share of distances measured in
    each round. Rows: vec_id, label, code (hex digits), error (squared distances of all parts).

    Vectors that are NULL or hold NULL or non-finite components are left out. A vector of other
    length than that of the smallest id, or of a length that four does not divide, cannot
    be coded: its code and error are NULL. Repeated rows are coded each, and all count for the
    means. With fewer than 256 ids the codebook is smaller. NULL ids are coded, but are no
    entry. A label may be NULL. An empty table gives no rows and no codebooks. A component of
    65,536 or more is an error, for its squares are not exact. Extra columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors, _ = stored_at(integer_vectors(embeddings), "codes-vectors")
    book = first_codebook(vectors)
    none = F.lit(None)
    if book is None:
        empty = vectors.select("vec_id", "label", none.cast("string").alias("code"), none.cast("bigint").alias("error"))
        return empty, [], []
    length = book.shape[0] * book.shape[2]
    history, shares, state, path = [book], [], vectors.where(F.size("v") == length), None
    for _ in range(rounds):
        state, old = _next_state(spark, state, history, path, shares)
        path = old
        history.append(_updated(history[-1], _sums(state, book.shape)))
    state, _ = _next_state(spark, state, history, path, shares)
    coded = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    rest = vectors.where(F.size("v") != length).select(
        "vec_id", "label", none.cast("string").alias("code"), none.cast("bigint").alias("error")
    )
    return coded.unionByName(rest), history, shares


def _next_state(spark, state, history, path, shares) -> tuple[DataFrame, str]:
    """The next round's state, stored; the one before is deleted once it is no longer read."""
    after, folder = stored_at(_assigned(state, history), "codes-state")
    if path is not None:
        discard(spark, path)
    seen = after.agg(F.sum("measured").alias("m"), F.count("*").alias("n")).first()
    shares.append((seen["m"] or 0) / max(1, seen["n"] * history[0].shape[0] * history[0].shape[1]))
    return after, folder


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the sum of error over rows of the same label, NULL labels together.

    One label may hold any share of the rows: sums combine before the shuffle and come
    back by broadcast, or, with very many labels, by a join on label and a salt.
    """
    spark = coded.sparkSession
    totals, _ = stored_at(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    totals = totals.withColumnRenamed("label", "_label")
    match = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= MAX_BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), match).drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
    copies = totals.withColumn("_other", F.explode(salts))
    return salted.join(copies, match & (F.col("_salt") == F.col("_other"))).drop("_label", "_salt", "_other")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings after four rounds. Cases as in ``compress``."""
    coded, history, _ = compress(table(spark, sf_dir, "embeddings"))
    mark = F.lit(book_digest(history[-1]) if history else None).cast("string")
    return with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", mark.alias("codebooks_sha256")
    )
