"""Secret scan: fixed patterns, and character Markov models for what they miss.

Two first-order Markov models over characters are trained from labelled samples of the
documents: values that the patterns find are random strings, all other long tokens are
ordinary. A token is a secret if its log-likelihood ratio is high enough. Everything is
column expressions; the scan of the documents is one narrow pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.llm.common import table

# Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")

ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_WORDS = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
MIN_ASSIGNED = 6
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
# What the models judge: long tokens that stand alone.
TOKEN = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_=-]{16,}+(?![\p{L}\p{N}])"
SAMPLE_TOKEN = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_=-]{6,}+(?![\p{L}\p{N}])"

# The models are fitted on about so many documents at most, chosen by hash.
TRAINING_DOCS = 4000
# Characters a token can have, for smoothing.
SYMBOLS = 67
# Log-likelihood ratios are integers, in thousandths of a nat.
UNIT = 1000
THRESHOLD = 10 * UNIT
MASK = "<secret>"

NO_SPANS = "array<struct<start:bigint,end:bigint>>"
_NO_MARKS = "array<struct<start:bigint,rank:int,end:bigint>>"


def let(value: Column, body) -> Column:
    """body(value), the value worked out once. Inside a lambda an expression is worked out anew at
    every mention, for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed(text: Column, pattern: str, good: Column | None = None) -> Column:
    """Spans (code points, end exclusive) of the leftmost matches of a pattern; of those only for
    which the array ``good`` holds, if given. The text between matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = [F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("size")]
    if good is not None:
        parts.append(good.alias("good"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        # Behind the last gap there is no match.
        end = start + F.coalesce(x["size"], F.lit(0))
        kept = x["size"].isNotNull() if good is None else x["good"]
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(kept, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    none = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast(NO_SPANS).alias("out")
    )
    return F.aggregate(F.arrays_zip(*parts), none, step, lambda state: state["out"])


def when_there(there: Column, spans: Column) -> Column:
    """Most texts have nothing of a kind; a cheap test spares them the rest."""
    return F.when(there, spans).otherwise(F.array().cast(NO_SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return {
        "assign": when_there(
            text.rlike(ASSIGN_WORDS),
            placed(text, ASSIGN, F.transform(values, lambda v: F.length(v) >= MIN_ASSIGNED)),
        ),
        "access": when_there(text.contains("AKIA"), placed(text, ACCESS)),
        "hex": when_there(text.rlike(HEX), placed(text, HEX)),
    }


def _bigram_counts(tokens: DataFrame, name: str) -> DataFrame:
    letters = F.split("token", "")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(letters) - 1),
        lambda i: F.ascii(F.element_at(letters, i)) * 128 + F.ascii(F.element_at(letters, i + 1)),
    )
    return (
        tokens.where(F.length("token") > 1)
        .select(F.explode(pairs).alias("pair"))
        .groupBy("pair")
        .agg(F.count("*").alias(name))
    )


def train(docs: DataFrame, sample_docs: int = TRAINING_DOCS) -> dict[int, int]:
    """Weight of each pair of characters, 128 * first + second code: the rounded log ratio of its
    probability in random strings and in ordinary tokens, in thousandths.

    Probabilities are smoothed by one count for each possible follower, so without any
    random string in the sample the random model is uniform. At most SYMBOLS squared
    weights reach the driver.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    text = F.col("text")
    patterns = (ACCESS, HEX)
    values = F.concat(
        # Shorter values are no secrets, so nothing to learn from either.
        F.filter(
            F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
            lambda v: F.length(v) >= MIN_ASSIGNED,
        ),
        *[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns],
    )
    secret = text.rlike(f"{ASSIGN_WORDS}|{ACCESS}|{HEX}")
    random = sample.where(secret).select(F.explode(values).alias("token"))
    rest = text
    for p in (ASSIGN, *patterns):
        rest = F.regexp_replace(rest, p, " ")
    ordinary = sample.select(
        F.explode(
            F.regexp_extract_all(
                F.when(secret, rest).otherwise(text), F.lit(SAMPLE_TOKEN), F.lit(0)
            )
        ).alias("token")
    )
    counts = _bigram_counts(random, "random").join(
        _bigram_counts(ordinary, "ordinary"), "pair", "full"
    )
    rows = counts.where((F.col("pair") % 128 > 0) & (F.col("pair") >= 128)).collect()
    return weights_of({r["pair"]: (r["random"] or 0, r["ordinary"] or 0) for r in rows})


def weights_of(counts: dict[int, tuple[int, int]]) -> dict[int, int]:
    """Weights by pair, and by 128 * first alone for followers that were never seen."""
    from math import log

    totals: dict[int, list[int]] = {}
    for pair, both in counts.items():
        total = totals.setdefault(pair // 128, [0, 0])
        total[0] += both[0]
        total[1] += both[1]

    def weight(random: int, ordinary: int, total: list[int]) -> int:
        ratio = (random + 1) * (total[1] + SYMBOLS) / ((ordinary + 1) * (total[0] + SYMBOLS))
        return round(UNIT * log(ratio))

    found = {128 * first: weight(0, 0, total) for first, total in totals.items()}
    for pair, (random, ordinary) in counts.items():
        found[pair] = weight(random, ordinary, totals[pair // 128])
    return found


def _weight_array(weights: dict[int, int]) -> Column:
    """All 128 * 128 weights as one constant."""
    dense = [
        weights.get(pair, weights.get(pair // 128 * 128, 0)) for pair in range(128 * 128)
    ]
    return F.split(F.lit(",".join(map(str, dense))), ",").cast("array<int>")


def log_ratio(token: Column, weights: dict[int, int]) -> Column:
    """Log-likelihood ratio of random over ordinary, in thousandths of a nat."""
    table_ = _weight_array(weights)
    return let(
        F.transform(F.split(token, ""), F.ascii),
        lambda codes: F.aggregate(
            F.sequence(F.lit(2), F.size(codes)),
            F.lit(0).cast("bigint"),
            lambda total, i: total
            + F.element_at(table_, F.element_at(codes, i - 1) * 128 + F.element_at(codes, i) + 1),
        ),
    )


def _random_spans(text: Column, weights: dict[int, int], threshold: int) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    high = F.transform(tokens, lambda t: log_ratio(t, weights) >= threshold)
    spans = placed(text, TOKEN, high)
    return when_there(F.exists(tokens, lambda t: log_ratio(t, weights) >= threshold), spans)


def _marks(spans: dict[str, Column]) -> Column:
    """Spans of all kinds as (start, rank of kind, end), sorted."""

    def ranked(kind: str):
        rank = F.lit(KINDS.index(kind)).alias("rank")
        return lambda x: F.struct(x["start"].alias("start"), rank, x["end"].alias("end"))

    each = [F.transform(column, ranked(kind)) for kind, column in spans.items()]
    return F.array_sort(F.concat(*each)).cast(_NO_MARKS)


def _listed(marks: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            marks,
            lambda m: F.concat_ws(":", F.element_at(names, m["rank"] + 1), m["start"], m["end"]),
        ),
        ",",
    )


def _scanned(docs: DataFrame, weights: dict[int, int], threshold: int) -> DataFrame:
    """row (the whole input row), text, and the spans of each kind."""
    text = F.col("text")
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(text.cast("string"), F.lit("")).alias("text")
    )
    found = rows.select(
        "row",
        "text",
        *[column.alias(kind) for kind, column in base_spans(text).items()],
        _random_spans(text, weights, threshold).alias("judged"),
    )
    # What a pattern has found already is not reported again.
    new = let(
        F.concat("assign", "access", "hex"),
        lambda base: F.filter(
            "judged",
            lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
        ),
    )
    return found.select("row", "text", "assign", "access", "hex", new.alias("random"))


def scan(
    docs: DataFrame, sample_docs: int = TRAINING_DOCS, threshold: int = THRESHOLD
) -> DataFrame:
    """Secrets of each row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256,
    spans.

    Needs doc_id and text; other columns are ignored. Spans are kind:start:end in code
    points, end exclusive, sorted by start. A NULL text counts as empty: no spans. Rows
    with NULL or repeated doc_id are scanned like any other. An empty table gives no rows.
    """
    found = _scanned(docs, train(docs, sample_docs), threshold)
    base = {k: F.col(k) for k in KINDS[:3]}
    return found.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(_marks(base)), 256).alias("base_sha256"),
        _listed(_marks(base | {"random": F.col("random")})).alias("spans"),
    )


def masked(docs: DataFrame, sample_docs: int = TRAINING_DOCS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with every secret replaced by a mask; spans that overlap get one mask.

    All columns are kept; n_chars, if there, follows the text. A NULL text stays NULL.
    """
    found = _scanned(docs, train(docs, sample_docs), threshold)
    marks = _marks({k: F.col(k) for k in KINDS})
    text = F.col("text")

    def step(state: Column, mark: Column) -> Column:
        gap = mark["start"] - state["at"]
        piece = F.concat(
            F.substring(text, (state["at"] + 1).cast("int"), gap.cast("int")), F.lit(MASK)
        )
        return F.struct(
            F.greatest(state["at"], mark["end"]).alias("at"),
            F.when(gap >= 0, F.concat(state["out"], F.array(piece)))
            .otherwise(state["out"])
            .alias("out"),
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")
    )
    clean = F.aggregate(
        "marks",
        start,
        step,
        lambda s: F.concat(
            F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))
        ),
    )
    rows = found.select("row", "text", marks.alias("marks")).select(
        "row", F.when(F.size("marks") > 0, clean).otherwise(F.col("row.text")).alias("clean")
    )
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return rows.select(
        *[
            changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan(table(spark, sf_dir, "documents"))
