from __future__ import annotations

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside.
CLASHING = "size bigint, key string, row string, n bigint, id bigint, part bigint, entities string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns of clashing names."""

    def build(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, "en", "s")[:4] if len(row) == 2 else (*row, "s")[:4]
            n_chars = None if text is None else len(text)
            full.append((doc_id, text, lang, source, n_chars, 1, "k", "r", 2, 3, 4, "e"))
        return spark.createDataFrame(full, f"{COLUMNS}, {CLASHING}")

    return build


LONG = "lorem ipsum dolor sit amet " * 30_000

# NULLs, empty and blank texts, a very long text, repeated rows and ids, odd characters.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (None, "a row without an id, token=abcdef123"),
    (4, LONG),
    (5, "the same row"),
    (5, "the same row"),
    (6, "one"),
    (7, "Größe naïve 東京 \U0001f600 \u0085   x\x1cy"),
    (8, "123 456 !!"),
]


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of([(*row, None, None) if i % 3 == 0 else row for i, row in enumerate(EDGES)])
