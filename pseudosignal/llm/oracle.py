"""DuckDB statements for the training-data operators that SQL can express."""

from __future__ import annotations

_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
_WORD = r"[^\x20\x09-\x0D]+"


def jaccard_sql(source: str = "documents", width: int = 3, percent: int = 90) -> str:
    """Components by Jaccard similarity of word n-grams, by counting every shared shingle."""
    parts = " || ' ' || ".join(f"w[i + {j}]" for j in range(width))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM {source}
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([{parts} FOR i IN range(1, len(w) - {width - 2})]) END AS s FROM split
), each AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS one FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.one = b.one AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS node FROM sets
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.node = both_ways.a
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, low AS component_id
FROM sets JOIN (SELECT doc_id, min(node) AS low FROM reach GROUP BY doc_id) USING (doc_id)
"""


def mixing_sql(source: str = "documents") -> str:
    """Words that the mix takes, by sorting every source whole."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM {source}
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_words, CAST(sum(w) OVER () AS BIGINT) AS all_w,
    CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS capped_words,
    CAST(coalesce(sum(w) OVER before, 0) AS BIGINT) AS capped_w FROM sources
  WINDOW before AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, (all_words - capped_words) / (all_w - capped_w) > 3 * source_size / w AS capped FROM ranked
), targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST(all_words - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0) AS BIGINT)
    / CAST(all_w - coalesce(sum(w) FILTER (capped) OVER (), 0) AS BIGINT) * w END AS target FROM judged
), budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM targets
), keyed AS (
  SELECT source, key, sum(size) AS words, count(*) AS n FROM sized GROUP BY source, key
), placed AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key) - words AS base FROM keyed
), joined AS (
  SELECT s.doc_id, s.source, s.size, b.source_size, b.target, p.base, p.words, p.n,
    CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
    CASE WHEN b.source_size > 0 THEN b.budget % b.source_size ELSE 0 END AS rest
  FROM sized s JOIN placed p ON s.source IS NOT DISTINCT FROM p.source AND s.key = p.key
  JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size +
  CASE WHEN base + words <= rest THEN size WHEN base < rest THEN (rest - base) // n ELSE 0 END AS BIGINT) AS taken
FROM joined
"""


# list_cosine_similarity of DuckDB works in the type of the list, so it is cast first.
NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
    AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS node FROM v
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.node = links.a
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, low AS component_id, v.vec_id = low AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = v.vec_id
LEFT JOIN (SELECT vec_id, min(node) AS low FROM reach GROUP BY vec_id) USING (vec_id)
"""

FIXITY = """
WITH sized AS (
  SELECT page_id, 'warc-' || CAST(page_id // 1000 AS VARCHAR) AS file,
    128 + coalesce(strlen(url), 0) + coalesce(strlen(html), 0) AS length,
    sha256(coalesce(strlen(url) || ':' || url, '-') || '|' || coalesce(strlen(html) || ':' || html, '-')) AS digest
  FROM pages
), records AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS INTEGER) % 100 AS fault FROM sized
), replica AS (
  SELECT file, "offset", CASE WHEN fault = 0 THEN sha256(digest) ELSE digest END AS digest
  FROM records WHERE fault <> 1
  UNION ALL SELECT file, "offset" + 1, digest FROM records WHERE fault = 2
)
SELECT coalesce(a.file, b.file) AS file, coalesce(a."offset", b."offset") AS "offset",
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
  a.digest AS primary_digest, b.digest AS replica_digest
FROM records a FULL JOIN replica b ON a.file = b.file AND a."offset" = b."offset"
WHERE a.digest IS DISTINCT FROM b.digest
"""

def manifest_sql(source: str = "documents", depth: int = 8, fanout: int = 8) -> str:
    """Leaves, proofs and folded roots, level by level; ``depth`` levels bound a language's rows
    by fanout to that power."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def one(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"

    def tree(name: str, leaves: str, levels: int) -> str:
        """CTEs name_0.. with (k, i, n, h) and, above the first, the list c of a node's children."""
        out = [f"{name}_0 AS MATERIALIZED (SELECT k, i, n, h FROM {leaves})"]
        for level in range(levels):
            out.append(
                f"{name}_{level + 1} AS MATERIALIZED (SELECT k, i // {fanout} AS i,"
                f" (any_value(n) + {fanout - 1}) // {fanout} AS n,"
                f" sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS c"
                f" FROM {name}_{level} WHERE n > 1 GROUP BY k, i // {fanout})"
            )
        tops = " UNION ALL ".join(
            f"SELECT k, h FROM {name}_{level} WHERE n = 1" for level in range(levels + 1)
        )
        return ", ".join([*out, f"{name}_top AS MATERIALIZED ({tops})"])

    def joins(name: str, levels: int, key: str, place: str) -> str:
        return " ".join(
            f"LEFT JOIN {name}_{level + 1} {name}{level} ON {name}{level}.k = {key}"
            f" AND {name}{level}.i = {place} // {fanout ** (level + 1)}"
            for level in range(levels)
        )

    def steps(name: str, levels: int, place: str) -> str:
        each = ", ".join(
            f"CASE WHEN {name}{level}.c IS NOT NULL THEN {{'l': array_to_string({name}{level}.c["
            f"1:({place} // {fanout ** level}) % {fanout}], ''), 'r': array_to_string({name}{level}.c["
            f"({place} // {fanout ** level}) % {fanout} + 2:], '')}} END"
            for level in range(levels)
        )
        return f"[x FOR x IN [{each}] IF x IS NOT NULL]"

    crc = (
        "xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN"
        " string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0,"
        " 0, 0, 0, 0], lambda b, y: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    )
    fields = " || ".join(one(c) for c in ("doc_id", "source", "lang", "n_chars"))
    upper = 3
    return f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS k, sha256({fields} || {one("text")}) AS h,
    CASE WHEN coalesce({crc} % 3 = 0, false) THEN sha256({fields} || {one(low)})
      ELSE sha256({fields} || {one("text")}) END AS seen FROM {source}
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
    count(*) OVER (PARTITION BY k) AS n FROM leaves
), {tree("l", "placed", depth)}, groups AS MATERIALIZED (
  SELECT '' AS k, k AS g, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM l_top
), {tree("g", "groups", upper)}, found AS (
  SELECT p.doc_id, p.h AS leaf, p.seen, groups.h AS subroot, g_top.h AS root, list_concat(
    {steps("l", depth, "p.i")}, {steps("g", upper, "groups.i")}) AS path
  FROM placed p JOIN groups ON groups.g = p.k CROSS JOIN g_top
  {joins("l", depth, "p.k", "p.i")} {joins("g", upper, "''", "groups.i")}
), folded AS (
  SELECT *, list_reduce(list_prepend({{'l': '', 'r': '', 'h': seen}}, [{{'l': x.l, 'r': x.r, 'h': ''}}
    FOR x IN path]), lambda a, x: {{'l': '', 'r': '', 'h': sha256(x.l || a.h || x.r)}}).h AS folded_root FROM found
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x.l || x.r FOR x IN path], '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded
"""


def vector_codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Codebooks and codes by measuring every distance. Sums of integers are exact in doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"codes_{r} AS MATERIALIZED (SELECT id, p, x, arg_min(j, (d, j)) AS j, min(d) AS d FROM"
            f" (SELECT s.id, s.p, s.x, b.j, list_inner_product(s.x, s.x) - 2 * list_inner_product(s.x, b.c)"
            f" + list_inner_product(b.c, b.c) AS d FROM split s JOIN book_{r} b ON s.p = b.p) GROUP BY id, p, x)"
        )
        if r < rounds:
            steps.append(
                f"book_{r + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM book_{r} b LEFT JOIN"
                f" (SELECT p, j, list(mean ORDER BY place) AS c FROM (SELECT p, j, place, floor(sum(v) / count(*)) AS mean"
                f" FROM (SELECT p, j, unnest(x) AS v, unnest(range(len(x))) AS place FROM codes_{r}) GROUP BY p, j, place)"
                f" GROUP BY p, j) m ON m.p = b.p AND m.j = b.j)"
            )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), split AS MATERIALIZED (
  SELECT id, vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x
  FROM kept CROSS JOIN range({parts}) t(p)
), book_0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS c FROM split
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
), {", ".join(steps)}, coded AS (
  SELECT id, string_agg(format('{{:02x}}', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM codes_{rounds} GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string([CAST(CAST(y AS BIGINT) AS VARCHAR) FOR y IN c], ','), ',' ORDER BY p, j))
    FROM book_{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (id)
"""


ORACLE = {
    "op1_warc_fixity": FIXITY,
    "op2_ngram_jaccard_join": jaccard_sql(),
    "op5_embedding_dedup": NEAR_VECTORS,
    "op4_source_mixing": mixing_sql(),
    "op11_vector_codes": vector_codes_sql(),
    "op13_dataset_manifest": manifest_sql(),
}
