"""Mixing of sources to target weights.

Every row has a hash-random key. Within its source, rows are taken in key order, whole
epochs first, then up to the exact number of words that is left. The order of a source is
cut into key ranges of bounded size: sums of the ranges give prefix sums over ranges, and
only the one range of a source in which its budget ends is sorted by key. So no source, of
whatever size, is sorted or gathered in one place, and the cut of a source is one row: its
key, and how many words of the row at that key are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pseudosignal.llm.common import WORD, stored, table

# Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
# No document is taken more often than this.
MAX_REPEATS = 3
# Rows of all sources to one key range.
ROWS_PER_RANGE = 20_000
SEED = "mix"
# Sources, a row of about 200 bytes each, that are broadcast; beyond, they are joined.
MAX_BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mixing_key(doc_id: Column, text: Column, seed: str) -> Column:
    """32 hex digits; rows with equal keys are equal in id and text."""
    return F.md5(
        F.concat(
            F.lit(f"{seed}|"),
            F.coalesce(doc_id.cast("string"), F.lit("")),
            F.lit("|"),
            F.coalesce(text, F.lit("")),
        ).cast("binary")
    )


def _source_key(source: Column) -> Column:
    """A source without NULL: joins on it find the NULL source too."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint"),
        F.col("source").cast("string"),
        _source_key(F.col("source").cast("string")).alias("s"),
        word_count(F.col("text")).alias("size"),
        mixing_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
    )


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """(s, source_size, target) from one row (s, source, source_size) for each source.

    All words are shared by weight; a source stops at ``cap`` times its size and the others
    share the excess. Sorted by cap over weight, a source is capped if its share of what
    the sources before it leave is above its cap. One row for each source is sorted here.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w).cast("bigint") for w in weights]),
        ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"),
    )
    whole = Window.partitionBy(F.lit(1))
    before = (
        Window.partitionBy(F.lit(1)).orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
    )

    def left(amount: Column, taken: Column) -> Column:
        return F.sum(amount).over(whole) - F.coalesce(taken, F.lit(0))

    size, most = F.col("source_size"), F.col("source_size") * cap
    ranked = sources.withColumn("w", weight).withColumn("ratio", most / F.col("w"))
    ranked = ranked.withColumn(
        "capped",
        left(size, F.sum(most).over(before)) / left(F.col("w"), F.sum("w").over(before))
        > F.col("ratio"),
    )
    words = left(size, F.sum(F.when(F.col("capped"), most)).over(whole))
    shares = left(F.col("w"), F.sum(F.when(F.col("capped"), F.col("w"))).over(whole))
    return ranked.select(
        "s",
        "source_size",
        F.when(F.col("capped"), most.cast("double"))
        .otherwise(words / shares * F.col("w"))
        .alias("target"),
    )


def _cuts(sized: DataFrame, weights: tuple) -> DataFrame:
    """One row for each source: source_size, target, epochs, and where the last epoch ends:
    cut_key, cut_words (of the rows at that key together) and cut_rows (their number)."""
    ranges = max(1, -(-sized.count() // ROWS_PER_RANGE))
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    ranged = sized.withColumn("range", F.shiftright(first * ranges, 32))
    sums = stored(
        ranged.groupBy("s", "source", "range").agg(F.sum("size").alias("words")), "mixing-ranges"
    )
    sources = sums.groupBy("s", "source").agg(F.sum("words").alias("source_size"))
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    targets = (
        source_targets(sources, weights)
        .withColumn("budget", budget)
        .withColumn("epochs", epochs.cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    along = (
        Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    ends = (
        sums.withColumn("base", F.coalesce(F.sum("words").over(along), F.lit(0)))
        .join(targets.select("s", "rest"), "s")
        .where("base <= rest and rest < base + words")
        .select("s", "range", F.col("rest") - F.col("base"))
        .toDF("s", "range", "rest")
    )
    within = Window.partitionBy("s", "range").orderBy("key")
    at_end = (
        ranged.join(ends, ["s", "range"])
        .groupBy("s", "range", "rest", "key")
        .agg(F.sum("size").alias("words"), F.count("*").alias("cut_rows"))
        .withColumn("base", F.sum("words").over(within) - F.col("words"))
        .where("base <= rest and rest < base + words")
        .select(
            "s",
            F.col("key").alias("cut_key"),
            (F.col("rest") - F.col("base")).alias("cut_words"),
            "cut_rows",
        )
    )
    cuts = targets.join(at_end, "s", "left").select(
        "s", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_rows"
    )
    cuts = stored(cuts, "mixing-cuts")
    # One source may have any share of the rows, so they are not dealt out by source,
    # unless there are too many sources to broadcast.
    return F.broadcast(cuts) if cuts.count() <= MAX_BROADCAST_SOURCES else cuts


def _last_epoch(size: Column, key: Column) -> Column:
    """Words of a row in the last, unfinished epoch of its source."""
    return (
        F.when(key < F.col("cut_key"), size)
        .when(key == F.col("cut_key"), F.expr("cut_words div cut_rows"))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of ``docs``.

    Needs doc_id, text and source; other columns are ignored. NULL is a source, the last
    one. A NULL or empty text has size 0 and is never taken. A source without words has
    target 0. Rows equal in id and text share a key; where a budget ends among them they
    take equal parts, so up to one word for each is left. Reruns agree, as keys depend on
    rows and seed only. An empty table gives no rows.
    """
    sized = stored(_sized(docs, seed), "mixing-sizes")
    joined = sized.join(_cuts(sized, weights), "s")
    taken = F.col("epochs") * F.col("size") + _last_epoch(F.col("size"), F.col("key"))
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, whole but for the one row
    of a source at which its budget ends: its last copy has only the words that are taken.

    All columns are kept; n_chars, if there, is that of the copy. Rows that are not taken go.
    """
    sized = stored(_sized(docs, seed), "mixing-sizes")
    cuts = _cuts(sized, weights)
    rows = docs.select(
        F.struct("*").alias("row"),
        _source_key(F.col("source").cast("string")).alias("s"),
        mixing_key(F.col("doc_id"), F.col("text"), seed).alias("key"),
    ).join(cuts, "s")
    text = F.col("row.text")
    words = word_count(text)
    # Only rows at a cut are cut; for all others the whole text is their part.
    part = F.when(
        F.col("key") == F.col("cut_key"),
        F.array_join(
            F.slice(
                F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)),
                F.lit(1),
                F.least(words, F.expr("cut_words div cut_rows")).cast("int"),
            ),
            "",
        ),
    ).when(F.col("key") < F.col("cut_key"), text)
    copies = F.concat(
        F.array_repeat(text, F.col("epochs").cast("int")),
        F.when(F.coalesce(part, F.lit("")) != "", F.array(part)).otherwise(F.array()),
    )
    taken = rows.where(F.coalesce(text.rlike(WORD), F.lit(False))).select(
        "row", F.explode(copies).alias("copy")
    )
    changed = {"text": F.col("copy"), "n_chars": F.length("copy").cast("bigint")}
    return taken.select(
        *[
            changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(table(spark, sf_dir, "documents"))
