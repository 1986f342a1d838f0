"""Self-join of documents on the Jaccard similarity of their word n-grams.

T-occurrence search in the manner of DivideSkip. A document of n shingles can only reach
similarity s with documents that share at least T = ceil(s n) of its shingles. Each of its
shingles has an inverted list. The T - k longest lists are set aside; any partner must then
occur k times in the other, short lists. Those are merged (counted); survivors are probed
in the long lists, which is a binary search in the partner's sorted shingles. An occurrence
counts only where it can be one of the first k: what follows it in either set must hold the
rest of the required overlap.

Long and short are told apart in one global order: by the count of a shingle's cell in a
count sketch of fixed size, then by hash. A cell counts at least the documents that have
the shingle. The order decides the speed only, never the result.

Copies must not expand into all pairs, so the work is done in steps:

1. Documents with equal sets become one class, represented by its smallest doc_id.
2. Postings of the short lists are written; lists with one class only are dropped.
3. Each list has a pivot; members that meet a pivot k times are verified against it, not
   against all. The links found already connect groups of near copies.
4. Lists that still hold several components get a new pivot, out of the largest of them, for
   members of the others: each is verified against the one, of some of its lists, whose parity
   map is nearest. Lists with one component are done.
5. Members of a list that are still in different components are merged, counted and, if
   they meet k times, verified. Pairs within one component can't change it. Two sets differ in
   at least as many shingles as their parity maps in bits; pairs that differ in too many
   bits are left out where they meet, so a group of copies that are all just too different does
   not come out as all its pairs.
6. Components of all links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.llm.common import (
    components,
    discard,
    maybe_in,
    membership_map,
    short_lived_shuffles,
    small_batches,
    stored,
    stored_at,
    table,
    without,
)

# Occurrences that a partner needs in the short lists.
MERGED = 2
# Cells of the count sketch, one byte each: 4 MiB, in chunks that travel compressed.
CELL_BITS = 22
CELL_SHIFT = np.uint64(64 - CELL_BITS)
CHUNK = 1 << 14
# Lanes in which sketches of tasks are added up first.
SKETCH_LANES = 32
# Bits of a set's parity map: each of its shingles turns one bit over. Shingles that meet in a bit hide
# a difference; they grow with the square of the differences that a link allows, which at a
# similarity of 0.9 or more are half of those at 0.8, so a quarter of the bits does.
PARITY_BITS = 1024
FEW_PARITY_BITS = 256
# Words whose hashes a worker remembers.
REMEMBERED_WORDS = 200_000
# Pivots for which the lists of a group of copies can vote.
LANES = 4
# Turns in which lists with several components get a new pivot, before their members are merged.
NEW_PIVOTS = 1
# New pivots that a document is compared with in one turn.
CHOICES = 8
# Partners of one document that are verified by one task.
PARTNERS_PER_TASK = 2000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingles:
    """Sorted 64-bit hashes of the distinct n-word shingles of a text in UTF-8.

    A-Z are lower-cased; words are separated by ASCII white space. Fewer words than n make
    one shingle of them all; no words make none.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.hashes = _WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        each = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        mixed = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            mixed = mixed * _A + each[i : len(words) - width + 1 + i]
            mixed ^= mixed >> np.uint64(32)
            mixed *= _B
        mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _parity_names(num: int, den: int) -> tuple[str, ...]:
    bits = FEW_PARITY_BITS if num * 10 >= den * 9 else PARITY_BITS
    return tuple(f"p{i}" for i in range(bits // 64))


def _parity(found: np.ndarray, bits: int) -> list[int]:
    odd = np.bincount(found.astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _profiles(
    batches: Iterator[pa.RecordBatch], width: int, names: tuple[str, ...]
) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, h1, h2, parity map) of each document; at the end (chunk, counts), the task's sketch."""
    shingles, cells = Shingles(width), np.zeros(1 << CELL_BITS, np.uint8)
    for batch in batches:
        n, h1, h2, parity = [], [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py() or b"")
            mark = xxhash.xxh3_128_intdigest(found.tobytes())
            n.append(len(found))
            h1.append(_signed(mark >> 64))
            h2.append(_signed(mark & (1 << 64) - 1))
            parity.append(_parity(found, 64 * len(names)))
            at = found >> CELL_SHIFT
            old = cells[at]
            cells[at] = old + (old < 255)
        none = [None] * len(n)
        maps = np.array(parity, np.int64).reshape(len(n), len(names)).T
        yield _rows(names, batch.column(0), n, h1, h2, *maps, none, none)
    for start in range(0, len(cells), 64 * CHUNK):
        some = cells[start : start + 64 * CHUNK].reshape(-1, CHUNK)
        used = np.flatnonzero(some.any(axis=1))
        if len(used):
            none = [None] * len(used)
            counts = [zlib.compress(some[i].tobytes(), 1) for i in used]
            yield _rows(names, *[none] * (4 + len(names)), used + start // CHUNK, counts)


def _profile_names(names: tuple[str, ...]) -> tuple[str, ...]:
    return ("doc_id", "n", "h1", "h2", *names, "chunk", "counts")


def _rows(names: tuple[str, ...], *columns) -> pa.RecordBatch:
    kinds = [pa.int64()] * (len(columns) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
        names=_profile_names(names),
    )


def _added(batches: Iterator[pa.RecordBatch], kind: type, last: bool) -> Iterator[pa.RecordBatch]:
    """Sketches added up by chunk; the last time as one byte, in steps above 191."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for i, key in enumerate(keys):
            part = np.frombuffer(zlib.decompress(batch.column(2)[i].as_py()), kind)
            total = sums.setdefault(key, np.zeros(CHUNK, np.uint32))
            np.add(total, part, out=total)
    for (chunk, lane), total in sums.items():
        if last:
            steps = 192 + 6 * np.log2(np.maximum(total, 192) / 192)
            out = np.where(total < 192, total, np.minimum(steps, 255)).astype(np.uint8)
        else:
            out = np.minimum(total, 65535).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.array([lane]), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())],
            names=["chunk", "lane", "counts"],
        )


def _sketch(profile: DataFrame):
    """The sketch of all documents, broadcast: 4 MiB, whatever the size of the data."""
    form = "chunk bigint, lane bigint, counts binary"
    parts = profile.where("chunk is not null").select(
        "chunk", F.pmod(F.xxhash64("counts"), F.lit(SKETCH_LANES)).alias("lane"), "counts"
    )
    lanes = parts.repartition("chunk", "lane").mapInArrow(
        lambda batches: _added(batches, np.uint8, False), form
    )
    whole = (
        lanes.select("chunk", F.lit(0).cast("bigint").alias("lane"), "counts")
        .repartition("chunk")
        .mapInArrow(lambda batches: _added(batches, np.uint16, True), form)
        .toArrow()
    )
    cells = np.zeros((1 << CELL_BITS) // CHUNK * CHUNK, np.uint8)
    for chunk, counts in zip(whole["chunk"].to_pylist(), whole["counts"].to_pylist(), strict=True):
        cells[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(
            zlib.decompress(counts), np.uint8
        )
    return profile.sparkSession.sparkContext.broadcast(cells)


def _required(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def _can_link(n: int, num: int, den: int) -> bool:
    """Whether some different set can be similar enough."""
    return n * den >= num * (n + 1)


def _short_lists(
    found: np.ndarray, cells: np.ndarray, num: int, den: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all but the T - k longest lists (and such that tie with the last of them), and
    how many of the set's shingles come before each in the order."""
    take = min(len(found), len(found) - _required(len(found), num, den) + k)
    order = (cells[found >> CELL_SHIFT].astype(np.uint64) << np.uint64(56)) | (
        found >> np.uint64(8)
    )
    short = order <= np.partition(order, take - 1)[take - 1]
    return found[short], np.searchsorted(np.sort(order[short]), order[short])


def _postings(
    batches: Iterator[pa.RecordBatch], width: int, cells: np.ndarray, num: int, den: int, k: int
) -> Iterator[pa.RecordBatch]:
    """(token, h1, h2, n, pos) for the short lists of each set; a worker writes a set only once."""
    shingles, seen = Shingles(width), set()
    for batch in batches:
        tokens, places, marks, sizes, lengths = [], [], [], [], []
        for text in batch.column(0):
            found = shingles(text.as_py() or b"")
            if not _can_link(len(found), num, den):
                continue
            mark = xxhash.xxh3_128_intdigest(found.tobytes())
            if mark in seen:
                continue
            if len(seen) < 1_000_000:
                seen.add(mark)
            short, place = _short_lists(found, cells, num, den, k)
            tokens.append(short)
            places.append(place)
            marks.append((_signed(mark >> 64), _signed(mark & (1 << 64) - 1)))
            sizes.append(len(found))
            lengths.append(len(short))
        if tokens:
            h = np.repeat(np.array(marks, np.int64), lengths, axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens).view(np.int64)),
                    pa.array(np.ascontiguousarray(h[:, 0])),
                    pa.array(np.ascontiguousarray(h[:, 1])),
                    pa.array(np.repeat(np.array(sizes, np.int64), lengths)),
                    pa.array(np.concatenate(places).astype(np.int64)),
                ],
                names=["token", "h1", "h2", "n", "pos"],
            )


def _probe(
    batches: Iterator[pa.RecordBatch], width: int, num: int, den: int
) -> Iterator[pa.RecordBatch]:
    """Of rows (a, part, b, text), sorted so that a's own text (b is NULL) comes first, the links."""
    shingles = Shingles(width)
    current, own = None, None
    for batch in batches:
        left, right = [], []
        texts = batch.column(3)
        for i, (a, b) in enumerate(
            zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
        ):
            found = shingles(texts[i].as_py() or b"")
            if b is None:
                current, own = a, found
                continue
            if a != current:
                raise RuntimeError("a document's own text must precede its partners")
            few, many = (found, own) if len(found) <= len(own) else (own, found)
            at = np.searchsorted(many, few)
            at[at == len(many)] = 0
            shared = int((many[at] == few).sum()) if len(many) else 0
            if den * shared >= num * (len(few) + len(many) - shared) and shared:
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
        )


def _verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough. Each b travels once, to its a, as text, which
    takes less than its shingles; a hot a is dealt out over several tasks."""
    fan = pairs.groupBy("a").agg(
        F.ceil(F.count("*") / F.lit(PARTNERS_PER_TASK)).cast("bigint").alias("parts")
    )
    own = (
        fan.join(texts, fan.a == texts.id)
        .select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)), "text")
        .select("a", F.col("col").alias("part"), F.lit(None).cast("bigint").alias("b"), "text")
    )
    partner = pairs.join(fan, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    partner = partner.join(texts, partner.b == texts.id).select("a", "part", "b", "text")
    rows = (
        own.union(partner)
        .repartition("a", "part")
        .sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    )
    return rows.mapInArrow(lambda batches: _probe(batches, width, num, den), "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, width: int = 3, similarity_percent: int = 90
) -> DataFrame:
    """Components of documents linked by Jaccard similarity, as (doc_id, n_shingles, component_id).

    One row for each row of ``docs``, which needs doc_id and text; other columns are ignored.
    component_id is the smallest doc_id reachable by links, itself included. Texts that are
    NULL, empty or without words have no shingles and link with nothing. A row with NULL
    doc_id takes no part; its component_id is NULL. Rows that repeat a doc_id count as one
    document with several texts. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    with short_lived_shuffles(docs.sparkSession):
        return _components_of(docs, width, similarity_percent, 100)


def _components_of(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    k = MERGED if num >= 2 * (den - num) else 1
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))

    parity = _parity_names(num, den)
    profile = stored(
        slim.mapInArrow(
            lambda batches: _profiles(batches, width, parity),
            ", ".join(f"{c} bigint" for c in _profile_names(parity)[:-1]) + ", counts binary",
        ),
        "ngram-profile",
    )
    own = profile.where("chunk is null").drop("chunk", "counts")
    cells = _sketch(profile)

    named = slim.where("doc_id is not null")
    postings, posted = stored_at(
        named.select("text").mapInArrow(
            lambda batches: _postings(batches, width, cells.value, num, den, k),
            "token bigint, h1 bigint, h2 bigint, n bigint, pos bigint",
        ),
        "ngram-postings",
    )
    classes = stored(
        own.where("n > 0 and doc_id is not null")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("id"), *[F.min(p).alias(p) for p in parity]),
        "ngram-classes",
    )
    maps = classes.select("id", *parity)
    lists, listed = stored_at(_shared_lists(postings, classes.drop(*parity)), "ngram-lists")
    # Each form of the lists goes as soon as the next is stored, so one of them is on disk.
    discard(spark, posted)

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = stored(ids, "ngram-ends")
        near = maybe_in(named, "doc_id", membership_map(ids, "id"))
        near = near.withColumnRenamed("doc_id", "id")
        return stored(near.join(ids, "id", "left_semi"), "ngram-texts")

    pivots = stored(_pivot_pairs(lists, num, den, k), "ngram-pivots")
    texts = texts_of(_ends(pivots))
    links = stored(_verified(pivots, texts, width, num, den), "ngram-links")
    found = components(links)
    for turn in range(NEW_PIVOTS):
        member, before = stored_at(_in_components(lists, found), "ngram-members")
        discard(spark, listed)
        lists, listed = stored_at(_open_lists(member, turn), "ngram-open")
        discard(spark, before)
        pairs = stored(_host_pairs(lists, maps, pivots, num, den), "ngram-pivots")
        texts = texts.union(texts_of(_ends(pairs).join(texts, "id", "left_anti")))
        new = stored(_verified(pairs, texts, width, num, den), "ngram-links")
        pivots, links = pivots.union(pairs), links.union(new)
        # Components of the components: no link found before travels again.
        found = _joined(found, new)
    member, before = stored_at(_in_components(lists, found), "ngram-members")
    discard(spark, listed)
    rest = stored(_merged_pairs(member, maps, pivots, num, den, k), "ngram-pairs")
    discard(spark, before)
    texts = texts.union(texts_of(_ends(rest).join(texts, "id", "left_anti")))
    more = _verified(rest, texts, width, num, den)

    member = own.drop(*parity).join(classes.drop(*parity), ["h1", "h2"], "left")
    spread = (
        member.where("doc_id is not null and id is not null")
        .groupBy("doc_id")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .where("low != high")
    )
    repeated = member.join(spread, "doc_id").select(F.col("low").alias("a"), F.col("id").alias("b"))
    found = stored(
        components(links.union(more).union(repeated.where("b is not null"))), "ngram-components"
    )
    return member.join(found, F.col("id") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")).alias(
            "component_id"
        ),
    )


def _shared_lists(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, id, n, pos) of the lists in which at least two classes occur.

    Most tokens are posted once. These are told by their count, so that no more than a token
    and its count travel for them. What is left travels once, with its classes.
    """
    twice = postings.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    some = maybe_in(postings, "token", membership_map(twice.select("token"), "token"))
    dealt = some.repartition("token")
    shared = (
        dealt.groupBy("token")
        .agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
        .where("low != high")
        .select("token")
    )
    return (
        dealt.join(shared, "token")
        .distinct()
        .join(classes, ["h1", "h2"])
        .select("token", "id", "n", "pos")
    )


def _can_meet(n: str, pos: str, m: str, place: str, num: int, den: int, k: int):
    """Sets of n and m shingles can be similar enough, and a shingle that they share at these places
    can be among the first k they share: what is left of either then holds the rest of T."""
    sizes = F.least(n, m) * den >= F.greatest(n, m) * num
    left = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(place)) + (k - 1)
    return sizes & (left * (num + den) >= (F.col(n) + F.col(m)) * num)


def _apart(num: int, den: int):
    """Bits in which the parity maps p.. and other_p.. differ."""
    names = _parity_names(num, den)
    return sum(F.bit_count(F.col(p).bitwiseXOR(F.col(f"other_{p}"))) for p in names)


def _not_apart(num: int, den: int):
    """The parity maps p.. and other_p.. differ in no more bits than the sets may in shingles."""
    return _apart(num, den) * (num + den) <= (F.col("n") + F.col("m")) * (den - num)


def _other(maps: DataFrame) -> list:
    """The columns of parity maps, as those of the other end."""
    return [F.col(p).alias(f"other_{p}") for p in maps.columns if p != "id"]


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def _pivot_pairs(lists: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """(a, b): a document and the pivot of k or more of its lists. In a group of copies most lists
    of a lane agree on the pivot, so pairs are few times the members. Pairs that are missed
    here are left to the merge."""
    vote = F.xxhash64(F.pmod("token", F.lit(LANES)), "id")
    pivots = lists.groupBy("token").agg(
        F.min_by("id", vote).alias("a"),
        F.min_by("n", vote).alias("m"),
        F.min_by("pos", vote).alias("place"),
    )
    return (
        lists.join(pivots, "token")
        .where((F.col("a") != F.col("id")) & _can_meet("n", "pos", "m", "place", num, den, k))
        .groupBy("a", F.col("id").alias("b"))
        .agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") >= k)
        .select("a", "b")
    )


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found``, joined where ``links`` connect them."""
    edges = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(edges.union(links.select("a", "b")))


def _in_components(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists with c, the component of each member."""
    return lists.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "token", "id", "n", "pos", F.coalesce("component", "id").alias("c")
    )


def _open_lists(member: DataFrame, turn: int) -> DataFrame:
    """Lists with several components: their members with c, the largest component as host, and
    a pivot (a, m, place) out of it, another one in each turn."""
    vote = F.xxhash64(F.pmod("token", F.lit(LANES)), "id", F.lit(turn))
    hosts = (
        member.groupBy("token", "c")
        .agg(F.count("*").alias("rows"), F.min(F.struct(vote, "id", "n", "pos")).alias("first"))
        .groupBy("token")
        .agg(
            F.max(F.struct("rows", "c", "first")).alias("host"),
            F.count("*").alias("cs"),
        )
        .where("cs > 1")
        .select(
            "token",
            F.col("host.c").alias("host"),
            F.col("host.first.id").alias("a"),
            F.col("host.first.n").alias("m"),
            F.col("host.first.pos").alias("place"),
        )
    )
    return member.join(hosts, "token")


def _host_pairs(
    lists: DataFrame, maps: DataFrame, done: DataFrame, num: int, den: int
) -> DataFrame:
    """(a, b): a document outside its lists' host and, of the pivots of some of its lists, the one
    whose parity map is nearest. What is missed here is left to the merge."""
    lane = F.pmod(F.xxhash64("token"), F.lit(CHOICES))
    pairs = (
        lists.where("c != host")
        .where(_can_meet("n", "pos", "m", "place", num, den, MERGED))
        .groupBy(F.col("id").alias("b"), lane.alias("lane"))
        .agg(F.min(F.struct("a", "n", "m")).alias("pivot"))
        .select("b", "pivot.*")
        .distinct()
    )
    other = maps.select(F.col("id").alias("a"), *_other(maps))
    near = _new_pairs(pairs, done).join(maps.withColumnRenamed("id", "b"), "b").join(other, "a")
    return (
        near.where(_not_apart(num, den))
        .groupBy("b")
        .agg(F.min_by("a", _apart(num, den)).alias("a"))
        .select("a", "b")
    )


def _new_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that are not in ``done`` either way round."""
    both = done.select("a", "b").union(done.select("b", "a"))
    return pairs.join(both, ["a", "b"], "left_anti")


def _merged_pairs(
    member: DataFrame, maps: DataFrame, done: DataFrame, num: int, den: int, k: int
) -> DataFrame:
    """Pairs in different components that occur together in at least k short lists.

    Members outside the list's largest component are the queries against the list, so the
    rows grow with those stragglers, not with the square of a group of copies. Only members
    of lists that still have several components get their parity map.
    """
    hosts = (
        member.groupBy("token", "c")
        .agg(F.count("*").alias("rows"))
        .groupBy("token")
        .agg(F.max_by("c", "rows").alias("host"), F.count("*").alias("cs"))
        .where("cs > 1")
        .select("token", "host")
    )
    hosts = stored(hosts, "ngram-hosts")
    some = maybe_in(member, "token", membership_map(hosts, "token"))
    open_lists = some.join(maps, "id").join(hosts, "token")
    query = open_lists.where("c != host").select(
        "token",
        F.col("id").alias("q"),
        F.col("n").alias("m"),
        F.col("pos").alias("place"),
        F.col("c").alias("qc"),
        *_other(maps),
    )
    pairs = (
        query.join(open_lists, "token")
        .where("c != qc and (c = host or q < id)")
        .where(_can_meet("n", "pos", "m", "place", num, den, k) & _not_apart(num, den))
        .groupBy(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b"))
        .agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") >= k)
    )
    return _new_pairs(pairs.select("a", "b"), done)


def one_of_each(docs: DataFrame, width: int = 5, similarity_percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id.

    All columns are kept. Rows with NULL doc_id stay. Of rows that repeat a doc_id that with
    the smallest text stays. Only rows that may have to go are shuffled.
    """
    found = jaccard_components(docs, width, similarity_percent).where("doc_id is not null")
    with short_lived_shuffles(docs.sparkSession):
        return _one_of_each(docs, stored(found, "ngram-found"))


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    gone = found.where("component_id != doc_id").select("doc_id").distinct()
    twice = (
        found.groupBy("doc_id")
        .agg(F.count("*").alias("rows"), F.max("component_id").alias("c"))
        .where("rows > 1 and c = doc_id")
        .select("doc_id")
    )
    single = without(docs, "doc_id", gone.union(twice))
    repeated = (
        maybe_in(docs, "doc_id", membership_map(twice, "doc_id"))
        .select(F.col("doc_id"), F.struct(*docs.columns).alias("row"), F.col("text").alias("order"))
        .join(twice, "doc_id")
        .groupBy("doc_id")
        .agg(F.min_by("row", F.coalesce("order", F.lit(""))).alias("row"))
    )
    return single.unionByName(repeated.select("row.*"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: three words, similarity 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90)
