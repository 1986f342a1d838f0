"""Strict JSON decoding of transactions, one document per line."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pseudosignal.schema import NUMBER_FIELDS, RAW_FIELDS, RAW_SCHEMA

MAX_PAYLOAD_BYTES = 1 << 20
INVALID_JSON = "invalid JSON"
OVERSIZE = "oversize"
_INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"

_STRICT = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
_CORRUPT = "_corrupt"
_NULL_DOCUMENT = r"\A[ \t\r\n]*null"

_TEXT_FIELDS = tuple(name for name in RAW_FIELDS if name not in NUMBER_FIELDS)
_COORDINATES = ("latitude", "longitude")

# Any key; any key with a text value; a known key in plain writing that is null.
_KEY = r'"\s*:'
_TEXT_VALUE = r'"\s*:\s*"'
_SET_TO_NULL = rf'"(?:{"|".join(RAW_FIELDS)})"\s*:\s*n'

# Every mention of a known key, whatever its case (long s and the Kelvin sign are other
# cases of s and k); those in plain writing with a value of their kind.
_MENTIONED = rf'(?iu)"(?:{"|".join(RAW_FIELDS)})"\s*:'
_WELL_TYPED = (
    rf'"(?:{"|".join(_TEXT_FIELDS)})"\s*:\s*["n]'
    rf'|"(?:{"|".join(NUMBER_FIELDS)})"\s*:\s*[-\dn]'
)
_ESCAPED_LETTER = r"(?i)\\u(?:00[4-7]|017f|212a)"


def read_lines(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Text files of one JSON transaction per line, as column ``value``.

    A partition directory such as ``institution_id=X`` becomes a text column: the types
    of such columns are not inferred, or ``007`` would become a number.
    """
    reader = spark.readStream if stream else spark.read
    with partitions_as_text(spark):
        return reader.options(**options).text(path)


@contextmanager
def partitions_as_text(spark: SparkSession) -> Iterator[None]:
    """Within it, folders that are opened have text partition columns."""
    before = spark.conf.get(_INFERENCE)
    spark.conf.set(_INFERENCE, "false")
    try:
        yield
    finally:
        spark.conf.set(_INFERENCE, before)


def decode_transactions(
    lines: DataFrame, value: str = "value", max_bytes: int = MAX_PAYLOAD_BYTES
) -> DataFrame:
    """Decode the text column to the raw columns plus ``decode_error``.

    All other columns stay. ``decode_error`` is NULL, ``invalid JSON`` or
    ``oversize``, and the raw columns are NULL where it is set. The rules:

    * known fields must be JSON strings or numbers of their kind, or null;
    * keys match in any case, and of repeated keys the last one counts, but every
      one must have the right type; null changes nothing, except that it clears a
      coordinate;
    * unknown keys, and text after the document, are ignored;
    * a document that does not end within ``max_bytes`` is oversize.

    One parse into named, typed fields serves nearly all lines. It is lenient about
    value types, cases and repeated keys, so pattern counts have to confirm it. A
    line with as many keys as fields found, and as many text values as text fields
    found, has nothing but known, distinct and well-typed keys. Lines with other keys
    are confirmed by counting the mentions of known keys. Any line left is parsed
    into the list of its entries and judged entry by entry. A line that cannot be
    listed is malformed: without ``spark.sql.variant.allowDuplicateKeys`` (see ``tune``)
    that also holds for lines to be listed that repeat a key inside an unknown field.
    """
    others = [c for c in lines.columns if c != value]
    too_long = F.octet_length(F.col(value)) > max_bytes
    # The document has to end within the limit; what comes after is not read at all.
    text = F.when(too_long, F.substring(F.col(value).cast("binary"), 1, max_bytes)).otherwise(
        F.col(value).cast("binary")
    )
    layout = T.StructType([*RAW_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = (
        lines.select(
            *others,
            too_long.alias("_too_long"),
            # Blanks around the document mean nothing, and there may be a MiB of them to search.
            F.trim(F.make_valid_utf8(text.cast("string"))).alias("_text"),
        )
        .withColumn(
            "_doc",
            F.from_json("_text", layout, {**_STRICT, "columnNameOfCorruptRecord": _CORRUPT}),
        )
        .withColumns({"_found": F.expr(_found(RAW_FIELDS)), "_texts": F.expr(_found(_TEXT_FIELDS))})
    )

    def count(pattern: str) -> Column:
        return F.regexp_count("_text", F.lit(pattern))

    def all_found(keys: Column) -> Column:
        return (keys == F.col("_found")) | (keys == F.col("_found") + count(_SET_TO_NULL))

    plain = (count(_TEXT_VALUE) == F.col("_texts")) & all_found(F.col("_keys"))
    counted = parsed.withColumn("_keys", count(_KEY)).withColumn("_plain", plain)
    mentions = F.col("_mentions")
    counted = counted.withColumn("_mentions", F.when(~F.col("_plain"), count(_MENTIONED)))
    confirmed = F.col("_plain") | (
        (mentions == count(_WELL_TYPED))
        & all_found(mentions)
        & ~F.col("_text").rlike(_ESCAPED_LETTER)
    )
    entries = F.map_entries(F.from_json("_text", "map<string,variant>", _STRICT))
    # Whether the entries decide; from here on the lenient parse of such a line is not used.
    slow = F.expr(f"_doc.{_CORRUPT} is null") & ~F.coalesce(confirmed, F.lit(False))
    listed = (
        counted.withColumn("_slow", F.coalesce(slow, F.lit(False)))
        .withColumn("_entries", F.when(F.col("_slow"), entries))
        .withColumn("_entries", F.expr(_FOLDED_ENTRIES))
    )
    typed = listed.select(
        *others,
        "_too_long",
        F.coalesce(F.col("_text").rlike(_NULL_DOCUMENT), F.lit(False)).alias("_null_doc"),
        F.expr(
            f"_doc is null or _doc.{_CORRUPT} is not null or (_slow and _entries is null)"
            f" or coalesce(exists(_entries, e -> {_MISTYPED_ENTRY}), false)"
        ).alias("_malformed"),
        *[F.expr(_field(name)).alias(name) for name in RAW_FIELDS],
    )
    overflow = " or ".join(f"coalesce(abs({n}) = double('Infinity'), false)" for n in NUMBER_FIELDS)
    malformed = ~F.col("_null_doc") & (F.col("_malformed") | F.expr(overflow))
    error = F.when(
        malformed, F.when(F.col("_too_long"), F.lit(OVERSIZE)).otherwise(F.lit(INVALID_JSON))
    )
    judged = typed.select(*others, *RAW_FIELDS, error.alias("decode_error"))
    # A document yields one row. Written as a generator, because filters are not
    # copied below one: a filter on any decoded column would otherwise parse the
    # text again for every mention of the column.
    usable = ", ".join(f"'{n}', if(decode_error is null, {n}, null)" for n in RAW_FIELDS)
    return judged.select(
        *others, F.expr(f"inline(array(named_struct({usable}, 'decode_error', decode_error)))")
    )


def _found(names: tuple[str, ...]) -> str:
    return " + ".join(f"int(_doc.{name} is not null)" for name in names)


def _sql_list(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{name}'" for name in names)


_FOLDED_ENTRIES = (
    "transform(_entries, e -> named_struct("
    "'key', translate(lower(e.key), 'ſ', 's'), 'value', e.value,"
    " 'kind', split_part(schema_of_variant(e.value), '(', 1)))"
)
_MISTYPED_ENTRY = (
    f"(e.key in ({_sql_list(_TEXT_FIELDS)}) and e.kind not in ('STRING', 'VOID'))"
    f" or (e.key in ({_sql_list(NUMBER_FIELDS)})"
    " and e.kind not in ('BIGINT', 'DECIMAL', 'DOUBLE', 'VOID'))"
)


def _field(name: str) -> str:
    """The typed field, or the last entry for it where the entries were listed."""
    kind = "double" if name in NUMBER_FIELDS else "string"
    counts = "true" if name in _COORDINATES else "e.kind <> 'VOID'"
    last = f"try_element_at(filter(_entries, e -> e.key = '{name}' and {counts}), -1)"
    return (
        f"if(_slow, try_variant_get({last}.value, '$', '{kind}'), _doc.{name})"
    )
