from __future__ import annotations

import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pseudosignal.llm import packing

from .conftest import EDGES


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def test_binary_lengths():
    assert packing.binary_lengths(1) == [1]
    assert packing.binary_lengths(4096) == [4096]
    assert packing.binary_lengths(2 * 4096 + 11) == [4096, 4096, 8, 2, 1]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "Plain words, and marks.",
        "<|endoftext|> stays special, <|ENDOFTEXT|> does not",
        "a\x1cb c\u0085d  e don't. x1. 'S. it's, ΣΑΣ. ,, .,. é. É. İ. K. ſ",
        "a.b, c,. '. d'. 's. 中文。 ,a",
        "oui&&& x'&s don'&& 12$$ a1%b é&& <|&& <&& &<| <|endoftext|>&&& w<|endoftext|> \x1c \u0085 a\u0301&&",
    ],
)
def test_words_one_by_one_give_the_ids_of_the_text(tokenizer, text):
    found = packing.WordIds(None)(text.encode())
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(found) // 4}I", found)) == want


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 50)
    ids = packing.WordIds(None)
    for i in range(60):
        text = f"word{i} other{i} again."
        found = ids(text.encode())
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(found) // 4}I", found)) == want
    assert len(ids.known) <= 60


def test_pieces_restore_every_row(edges, tokenizer):
    rows = packing.pack(edges).collect()
    digest = packing.digest(packing.pack(edges)).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert {r["offset"] for r in rows} == {0}
    by_doc: dict = {}
    for r in rows:
        assert len(r["tokens"]) == 4 * r["length"] and r["length"] == 1 << r["bucket"] <= 4096
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sorted(zlib.crc32(r["tokens"]) for r in rows) == sorted(r["ids_crc32"] for r in digest)
    for doc_id, text in EDGES:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        found = sorted(by_doc[doc_id], key=lambda r: (r["start"], r["sequence_id"]))
        copies = sum(d == doc_id for d, _ in EDGES)
        assert sum(r["length"] for r in found) == copies * len(want)
        whole = b"".join(r["tokens"] for r in found[::copies])
        assert list(struct.unpack(f"<{len(whole) // 4}I", whole)) == want
        assert {r["doc_tokens"] for r in found} == {len(want)}


def test_no_rows_give_no_pieces(docs_of):
    assert packing.pack(docs_of([])).count() == 0


def test_length_must_be_a_power_of_two(docs_of):
    with pytest.raises(ValueError):
        packing.pack(docs_of([]), max_length=1000)


def test_buckets_hold_equal_lengths(spark, docs_of, tmp_path):
    packing.write_buckets(packing.pack(docs_of([(1, "a b c"), (2, "d e")])), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert {(r["bucket"], r["length"]) for r in back.collect()} == {(2, 4), (1, 2), (0, 1)}
