"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many whole
windows as fit, then one piece for each binary digit of the rest. Pieces of equal length
form a bucket, and a batch of one bucket needs no padding. As every piece is a sequence of
its own, no sequence crosses documents. It is a map over documents: nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudosignal.llm.common import small_batches, table

VOCABULARY = "word_bpe_49k.json"
MAX_LENGTH = 4096
END_ID = 2
# A special token of the vocabulary.
BETWEEN = "<|endoftext|>"

# Words whose ids a worker process remembers. Beyond it the memory starts anew.
REMEMBERED_WORDS = 800_000
# Token bytes in one output batch.
OUTPUT_BYTES = 16 << 20

PIECES = (
    "doc_id bigint, start bigint, length bigint, tokens binary, ids_crc32 bigint, "
    "doc_tokens bigint, bucket int"
)


# An ASCII word without marks inside, and the marks after it.
_MARKED = re.compile(rb"([a-z0-9]+)([^a-z0-9\x80-\xff]+)")
# Words that are tokenized in one call.
JOINED = 256


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins across white space, so a text's ids are those of its words
    in order, and each distinct word is tokenized once. (Split at ASCII white space only:
    other separators stay inside a word and are left to the tokenizer.)

    More savings, as the tokenizer lower-cases, never joins letters or digits with
    punctuation, and treats what lies between special tokens on its own: A-Z are lower-cased
    first, unless a special token, which is matched in the text as it is, may be there; a plain
    word and the marks after it are looked up apart; and many new words go to the
    tokenizer in one text, with a special token between them.
    """

    def __init__(self, path: str | None) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.known: dict[bytes, bytes] = {}

    def __call__(self, text: bytes) -> bytes:
        return self.all([text])[0]

    def all(self, texts: list[bytes]) -> list[bytes]:
        known = self.known
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        new = set().union(*split).difference(known)
        if len(known) + 2 * len(new) > REMEMBERED_WORDS:
            known.clear()
            new = set().union(*split)
        marked = [m for m in map(_MARKED.fullmatch, new) if m]
        new.difference_update(m[0] for m in marked)
        for m in marked:
            new.update(m.groups())
        self._learn([word for word in new if word not in known])
        for m in marked:
            known[m[0]] = known[m[1]] + known[m[2]]
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _learn(self, words: list[bytes]) -> None:
        apart = self.between is None
        alone = [w for w in words if apart or b"<|" in w]
        rest = [] if apart else [w for w in words if b"<|" not in w]
        groups = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        groups += [[w] for w in alone]
        texts = [BETWEEN.join(w.decode("utf-8", "replace") for w in group) for group in groups]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for group, one in zip(groups, found, strict=True):
            ids = np.array(one.ids, "<u4")
            ends = [] if len(group) == 1 else np.flatnonzero(ids == self.between).tolist()
            whole, start = ids.tobytes(), 0
            for word, end in zip(group, [*ends, len(ids)], strict=True):
                self.known[word] = whole[4 * start : 4 * end]
                start = end + 1


@cache
def word_ids(path: str | None) -> WordIds:
    """One for each worker process, so that its tasks share what it remembers."""
    return WordIds(path)


def binary_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Powers of two that add up to n, longest first, none above max_length."""
    whole, rest = divmod(n, max_length)
    digits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return [max_length] * whole + digits


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
    tokens: bool = True,
) -> DataFrame:
    """Pieces of every document: doc_id, start, length, tokens (little-endian unsigned 32-bit
    ids), ids_crc32 (checksum of these), doc_tokens, bucket (binary logarithm of length),
    sequence_id, offset. With ``tokens=False`` that column is NULL: for checksums alone.

    ``docs`` needs doc_id and text; other columns are ignored. A NULL or empty text has the
    end id only. A NULL doc_id and repeated rows are packed like any other row. An empty
    table gives no pieces. ``max_length`` must be a power of two. ``tokenizer_path`` must be
    readable on the executors; by default it is looked up there.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, word_ids(tokenizer_path), max_length, end_id, tokens)

    pieces = slim.mapInArrow(run, PIECES)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("bigint")
    )


def _pieces(
    batches: Iterator[pa.RecordBatch], ids_of: WordIds, max_length: int, end_id: int, tokens: bool
) -> Iterator[pa.RecordBatch]:
    end = end_id.to_bytes(4, "little")
    columns: list[list] = [[] for _ in range(7)]
    size = 0
    for batch in batches:
        docs = batch.column(0).to_pylist()
        found = ids_of.all([text or b"" for text in batch.column(1).to_pylist()])
        for doc, ids in zip(docs, found, strict=True):
            ids += end
            start = 0
            for length in binary_lengths(len(ids) // 4, max_length):
                piece = ids[4 * start : 4 * (start + length)]
                kept = piece if tokens else None
                row = (doc, start, length, kept, zlib.crc32(piece), len(ids) // 4)
                for column, value in zip(columns, (*row, length.bit_length() - 1), strict=True):
                    column.append(value)
                start += length
            size += len(ids)
            if size >= OUTPUT_BYTES:
                yield _batch(columns)
                columns, size = [[] for _ in range(7)], 0
    if columns[0]:
        yield _batch(columns)


def _batch(columns: list[list]) -> pa.RecordBatch:
    long = pa.int64()
    types = (long, long, long, pa.binary(), long, long, pa.int32())
    names = ("doc_id", "start", "length", "tokens", "ids_crc32", "doc_tokens", "bucket")
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
    )


def write_buckets(pieces: DataFrame, path: str, mode: str = "append") -> None:
    """Sequences in one folder for each bucket; batches of a folder need no padding."""
    pieces.hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of the ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )


def op10_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document."""
    return digest(pack(table(spark, sf_dir, "documents"), tokens=False))
