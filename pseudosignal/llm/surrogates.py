"""Surrogates for personal data.

Detected entities get replacements that depend on a key and on the entity alone, so the same
entity has the same surrogate everywhere and texts stay coherent. Card, phone and identity
numbers, addresses of machines and mail addresses are permuted by a keyed Feistel network
over the characters of each class: digits stay digits, letters stay letters of their case,
the format stays as it is, check digits are right, and two entities can't get one surrogate.
Names are spelled from syllables of their script, with endings of the title's gender; there
a check counts collisions over all names, and a new attempt is made until there are none.

Everything is column expressions in one narrow pass; only the check shuffles, and only
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.llm.common import stored, table
from pseudosignal.llm.secrets import NO_SPANS, let, placed, when_there

# The key of the registered query. Callers bring their own.
QUERY_KEY = "surrogates of the sample query"

# Where spans overlap, the kind that comes first wins.
KINDS = ("email", "ip", "card", "ssn", "phone", "name")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Titles, by gender: Latin, Cyrillic and Greek.
_MALE = r"(?:Mr\.?|Herrn?|Señor|Monsieur|г-н|κ\.)"
_FEMALE = r"(?:Mrs\.?|Ms\.?|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|г-жа|κα)"
_NAME_WORD = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@"
    r"[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?"
    r"(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|"
    r"(?<=\+[0-9]{1,3}[ .-]?)[0-9]{2,4}[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4})(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_MALE}|{_FEMALE})\x20{_NAME_WORD}(?:\x20{_NAME_WORD})?+",
}
# What a text must have at least to be searched for a kind.
_THERE = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9]{13}|[0-9]{4}[ -][0-9]{4}"),
    "ssn": lambda text: text.rlike(r"[0-9]-[0-9]"),
    "phone": lambda text: text.rlike(r"\+[0-9]|\([0-9]"),
    "name": lambda text: text.rlike(rf"(?:{_MALE}|{_FEMALE})\x20\p{{Lu}}"),
}

ROUNDS = 6
ATTEMPTS = 8


def _digit(char: Column) -> Column:
    return F.ascii(char) - 48


def _text_digits(digits: Column) -> Column:
    return F.array_join(F.transform(digits, lambda d: d.cast("string")), "")


def _luhn(digits: Column) -> Column:
    """The check digit of a body of digits (array of int)."""
    n = F.size(digits)

    def term(d: Column, i: Column) -> Column:
        twice = F.when((n - i) % 2 == 1, 2 * d).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(digits, term), F.lit(0), lambda s, d: s + d)
    return (10 - total % 10) % 10


def _luhn_holds(entity: Column) -> Column:
    digits = F.transform(F.split(F.regexp_replace(entity, "[^0-9]", ""), ""), _digit)
    return let(
        F.struct(
            F.slice(digits, F.lit(1), F.size(digits) - 1).alias("body"),
            F.element_at(digits, -1).alias("check"),
        ),
        lambda d: _luhn(d["body"]) == d["check"],
    )


def _byte(digest: Column, i: Column) -> Column:
    """Two bytes of a hex digest, by position; wraps after 16."""
    return F.conv(F.substring(digest, i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _feistel(codes: Column, sizes: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of arrays of small numbers. sizes[i] is how many values place i has;
    each half in turn is shifted, place by place, by a digest of the other half."""

    def permuted(given: Column) -> Column:
        sizes = given["sizes"]
        n = F.size(sizes)
        half = (n / 2).cast("int")

        def step(state: Column, r: Column) -> Column:
            odd = r % 2 == 1
            fixed = F.when(odd, F.slice(state, F.lit(1), half)).otherwise(
                F.slice(state, half + 1, n - half)
            )
            parts = (key, F.lit(kind), r, given["frame"], F.array_join(fixed, ","))
            return let(
                F.sha2(F.concat_ws("|", *parts), 256),
                lambda digest: F.transform(
                    state,
                    lambda c, i: F.when(
                        odd == (i >= half), (c + _byte(digest, i)) % F.element_at(sizes, i + 1)
                    ).otherwise(c),
                ),
            )

        return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), given["codes"], step)

    return let(
        F.struct(
            codes.alias("codes"), sizes.alias("sizes"), F.array_join(sizes, ",").alias("frame")
        ),
        permuted,
    )


def _permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """Digits (array of int), permuted among those of the same number."""
    return let(
        digits, lambda d: _feistel(d, F.transform(d, lambda _: F.lit(10)), key, kind)
    )


def _refilled(entity: Column, digits: Column) -> Column:
    """The entity with its digits replaced in order."""
    chars = F.split(entity, "")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def filled(new: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            put = F.when(is_digit, F.element_at(new, state["used"] + 1).cast("string")).otherwise(c)
            return F.struct(
                (state["used"] + is_digit.cast("int")).alias("used"),
                F.concat(state["out"], F.array(put)).alias("out"),
            )

        return F.aggregate(chars, start, step, lambda s: F.array_join(s["out"], ""))

    return let(digits, filled)


def _digits(entity: Column) -> Column:
    bare = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(bare != "", F.transform(F.split(bare, ""), _digit)).otherwise(
        F.array().cast("array<int>")
    )


def _number(entity: Column, key: Column, kind: str) -> Column:
    return _refilled(entity, _permuted_digits(_digits(entity), key, kind))


def _phone(entity: Column, key: Column) -> Column:
    """The country code stays."""
    code = F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[^0-9])", 0)
    rest = F.substring(entity, F.length(code) + 1, F.length(entity))
    return F.concat(code, _number(rest, key, "phone"))


def _card(entity: Column, key: Column) -> Column:
    """The body is permuted, the check digit computed."""
    body = let(_digits(entity), lambda d: F.slice(d, F.lit(1), F.size(d) - 1))
    digits = let(
        _permuted_digits(body, key, "card"), lambda b: F.concat(b, F.array(_luhn(b)))
    )
    return _refilled(entity, digits)


def _ip(entity: Column, key: Column) -> Column:
    octets = F.transform(F.split(entity, r"\."), lambda o: o.cast("int"))
    moved = let(octets, lambda o: _feistel(o, F.transform(o, lambda _: F.lit(256)), key, "ip"))
    return F.array_join(F.transform(moved, lambda o: o.cast("string")), ".")


def _same_class(text: Column, key: Column, kind: str) -> Column:
    """Lower-case text with letters and digits permuted, each within its class."""
    chars = F.split(text, "")
    is_digit, is_letter = lambda c: c.between("0", "9"), lambda c: c.between("a", "z")
    sizes = F.transform(
        chars, lambda c: F.when(is_digit(c), 10).when(is_letter(c), 26).otherwise(1)
    )
    codes = F.transform(
        chars,
        lambda c: F.when(is_digit(c), F.ascii(c) - 48)
        .when(is_letter(c), F.ascii(c) - 97)
        .otherwise(0),
    )
    # Other characters are part of the format, hence of the permutation's name.
    frame = F.array_join(
        F.transform(
            chars, lambda c: F.when(is_digit(c), "0").when(is_letter(c), "a").otherwise(c)
        ),
        "",
    )
    moved = _feistel(codes, sizes, key, kind)
    out = F.transform(
        F.arrays_zip(F.split(frame, "").alias("f"), moved.alias("m")),
        lambda x: F.when(x["f"] == "0", F.char(x["m"] + 48))
        .when(x["f"] == "a", F.char(x["m"] + 97))
        .otherwise(x["f"]),
    )
    return F.when(text == "", "").otherwise(F.array_join(out, ""))


def _email(entity: Column, key: Column) -> Column:
    """Local part and domain apart, so addresses of one domain stay together; the last label
    stays. Addresses that differ in case only have one surrogate, in their own case."""
    low = F.lower(entity)
    local = F.substring_index(low, "@", 1)
    domain = F.substring_index(low, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    made = F.concat(
        _same_class(local, key, "local"),
        F.lit("@"),
        _same_class(host, key, "host"),
        F.lit("."),
        top,
    )
    return F.array_join(
        F.transform(
            F.arrays_zip(F.split(entity, "").alias("e"), F.split(made, "").alias("m")),
            lambda x: F.when(x["e"].between("A", "Z"), F.upper(x["m"])).otherwise(x["m"]),
        ),
        "",
    )


# Syllables, and endings by gender, of each script.
_SYLLABLES = {
    "Latin": "ba be bo da de di fa fe ga ka la le li lo ma mi na ne no ra re ri ro sa se ta te ti va vi za zo",
    "Cyrillic": "ба бе бо да де ди фа фе га ка ла ле ли ло ма ми на не но ра ре ри ро са се та те ти ва ви за зо",
    "Greek": "βα βε βο δα δε δι φα φε γα κα λα λε λι λο μα μι να νε νο ρα ρε ρι ρο σα σε τα τε τι ζα ζι ξα ξο",
}
_ENDINGS = {
    ("Latin", True): "n s r l",
    ("Latin", False): "a ia na ina",
    ("Cyrillic", True): "н р й л",
    ("Cyrillic", False): "а ия на ина",
    ("Greek", True): "ς ος ης ας",
    ("Greek", False): "α ια η να",
}


def _spelled(digest: Column, first: int, count: int, script: str) -> Column:
    syllables = F.split(F.lit(_SYLLABLES[script]), " ")
    places = F.sequence(F.lit(first), F.lit(first + count - 1))
    spelled = F.transform(places, lambda i: F.element_at(syllables, _byte(digest, i) % 32 + 1))
    return F.array_join(spelled, "")


def _name(entity: Column, key: Column, attempt: int) -> Column:
    """Title as it is; given and family name, or one name, as before. 75 bits of the digest of a
    whole name are spelled out, 50 of a single one."""
    title = F.substring_index(entity, " ", 1)
    own = F.substring(entity, F.length(title) + 2, F.length(entity))
    male = title.rlike(f"^{_MALE}$")
    whole = F.sha2(F.concat_ws("|", key, F.lit("name"), F.lit(attempt), own), 256)
    two = own.contains(" ")

    def made(script: str, digest: Column) -> Column:
        ends = {
            g: F.element_at(
                F.split(F.lit(_ENDINGS[script, g]), " "),
                _byte(digest, F.lit(15)) % 4 + 1,
            )
            for g in (True, False)
        }
        ending = F.when(male, ends[True]).otherwise(ends[False])
        long = F.initcap(F.concat(_spelled(digest, 0, 10, script), ending))
        given = F.initcap(F.concat(_spelled(digest, 0, 5, script), ending))
        family = F.initcap(_spelled(digest, 5, 10, script))
        return F.when(two, F.concat_ws(" ", given, family)).otherwise(long)

    new = let(
        whole,
        lambda digest: F.when(own.rlike(r"^\p{IsCyrillic}"), made("Cyrillic", digest))
        .when(own.rlike(r"^\p{IsGreek}"), made("Greek", digest))
        .otherwise(made("Latin", digest)),
    )
    return F.concat_ws(" ", title, new)


def _found(text: Column) -> dict[str, Column]:
    spans = {}
    for kind in KINDS:
        found = placed(text, PATTERNS[kind])
        if kind == "card":
            # Long numbers are cards only if their check digit is right.
            found = F.filter(found, lambda s: _luhn_holds(_part(text, s)))
        spans[kind] = when_there(_THERE[kind](text), found)
    return spans


def _part(text: Column, span: Column) -> Column:
    return F.substring(
        text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")
    )


def detect(docs: DataFrame) -> DataFrame:
    """row (the whole input row), text and entities: kind number, start, end and text of each, in
    order of place; spans that overlap one of an earlier kind are dropped."""
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    spans = rows.select("row", "text", *[c.alias(f"_{k}") for k, c in _found(F.col("text")).items()])
    taken: list[str] = []
    for kind in KINDS:
        if taken:
            before = F.concat(*[F.col(t) for t in taken])
            free = _free(F.col(f"_{kind}"), before)
            none = F.array().cast(NO_SPANS)
            spans = spans.withColumn(
                f"_{kind}", F.when(F.size(f"_{kind}") > 0, free).otherwise(none)
            )
        taken.append(f"_{kind}")

    def marked(number: int):
        def mark(s: Column) -> Column:
            return F.struct(
                s["start"].alias("start"),
                F.lit(number).alias("kind"),
                s["end"].alias("end"),
                _part(F.col("text"), s).alias("entity"),
            )

        return mark

    every = F.concat(*[F.transform(f"_{k}", marked(i)) for i, k in enumerate(KINDS)])
    return spans.select("row", "text", F.array_sort(every).alias("entities"))


def _free(spans: Column, before: Column) -> Column:
    return let(
        before,
        lambda taken: F.filter(
            spans,
            lambda s: ~F.exists(taken, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])),
        ),
    )


def surrogate(kind: Column, entity: Column, key: Column, attempt: int = 0) -> Column:
    made = {
        "email": _email(entity, key),
        "ip": _ip(entity, key),
        "card": _card(entity, key),
        "ssn": _number(entity, key, "ssn"),
        "phone": _phone(entity, key),
        "name": _name(entity, key, attempt),
    }
    out = F.when(kind == 0, made[KINDS[0]])
    for number, name in enumerate(KINDS[1:], 1):
        out = out.when(kind == number, made[name])
    return out


# The column that holds the key.
KEY = "_surrogate_key"


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the key as a column of a one-row table. As a literal it could be read in the
    query plan, and in event logs; the rows of a table made from values are in neither."""
    one = df.sparkSession.createDataFrame([(0, key)], f"_one int, {KEY} string")
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")


def _settled_attempt(found: DataFrame) -> int:
    """The first attempt in which no two names get one surrogate, and none gets another's name.

    Looks at all names in the texts, also at those inside of other entities; they are
    searched for once. What is written are keyed digests of names and surrogates, no names.
    """
    text, key = F.col("text"), F.col(KEY)
    every = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))

    def mark(name: Column) -> Column:
        return F.sha2(F.concat_ws("|", key, F.lit("mark"), name), 256)

    names = found.where(_THERE["name"](text)).select(KEY, F.explode(every).alias("entity")).distinct()
    marks = stored(
        names.select(
            mark(F.col("entity")).alias("entity"),
            *[mark(_name(F.col("entity"), key, i)).alias(f"made{i}") for i in range(ATTEMPTS)],
        ),
        "surrogate-marks",
    )
    for attempt in range(ATTEMPTS):
        made = marks.select(F.col(f"made{attempt}").alias("made"))
        twice = made.groupBy("made").agg(F.count("*").alias("n")).where("n > 1")
        real = made.join(marks.select("entity"), F.col("made") == F.col("entity"), "left_semi")
        if twice.isEmpty() and real.isEmpty():
            return attempt
    raise RuntimeError(f"names still collide after {ATTEMPTS} attempts; use another key")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """row, text with surrogates, and entities (start, kind, end, entity, surrogate) of each row."""
    found = _keyed(detect(docs), key)
    attempt, key = _settled_attempt(found), F.col(KEY)
    entities = F.transform(
        "entities",
        lambda e: F.struct(
            e["start"].alias("start"),
            e["kind"].alias("kind"),
            e["end"].alias("end"),
            e["entity"].alias("entity"),
            surrogate(e["kind"], e["entity"], key, attempt).alias("surrogate"),
        ),
    )
    replaced = found.select("row", "text", entities.alias("entities"))
    text = F.col("text")

    def step(state: Column, e: Column) -> Column:
        gap = F.substring(
            text, (state["at"] + 1).cast("int"), (e["start"] - state["at"]).cast("int")
        )
        return F.struct(
            e["end"].alias("at"),
            F.concat(state["out"], F.array(gap, e["surrogate"])).alias("out"),
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")
    )
    new = F.aggregate(
        "entities",
        start,
        step,
        lambda s: F.concat(
            F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))
        ),
    )
    return replaced.select(
        "row", F.when(F.size("entities") > 0, new).otherwise(F.col("row.text")).alias("text"), "entities"
    )


def anonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_ssn, n_phone, n_name, spans, text) for each row of ``docs``,
    text with surrogates.

    Needs doc_id and text; other columns are ignored. Spans are kind:start:end of the
    original text in code points, end exclusive. A NULL text stays NULL without entities.
    NULL and repeated doc_ids are rows like any other. An empty table gives no rows.
    """
    done = replace(docs, key)
    names = F.array(*[F.lit(k) for k in KINDS])

    def counted(number: int) -> Column:
        return F.size(F.filter("entities", lambda e: e["kind"] == number)).cast("bigint")

    return done.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"),
        *[counted(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_join(
            F.transform(
                "entities",
                lambda e: F.concat_ws(":", F.element_at(names, e["kind"] + 1), e["start"], e["end"]),
            ),
            ",",
        ).alias("spans"),
        "text",
    )


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return anonymise(table(spark, sf_dir, "documents"), QUERY_KEY)
