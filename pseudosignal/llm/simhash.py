"""SimHash values of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np

BITS = 128
# Bytes of text that are hashed at once; longer documents go through in blocks.
BLOCK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, size: int) -> np.ndarray:
    if len(_powers[name]) < size:
        steps = np.full(max(size, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spaces(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def _block_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z in lower case."""
    gap = _spaces(data)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    low = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    # Sum of byte times power of its place; dividing by the power of the start makes it a
    # polynomial of the word alone.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _power("down", _BACK, len(data) + 1)[starts])


def words_of(text: bytes) -> np.ndarray:
    """Hashes of all words of a text, in order."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= BLOCK:
        return _block_words(data)
    found, start = [], 0
    while start < len(data):
        end = start + BLOCK
        while end < len(data):
            # A block ends before a gap, so no word is cut.
            gaps = np.flatnonzero(_spaces(data[end : end + BLOCK]))
            if len(gaps):
                end += int(gaps[0])
                break
            end += BLOCK
        found.append(_block_words(data[start:end]))
        start = end
    return np.concatenate(found)


def terms_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` words in a row; of the words of a text with fewer."""
    if len(words) < width:
        return words
    joined = words[: len(words) - width + 1]
    for i in range(1, width):
        joined = _mixed(joined * np.uint64(3) + words[i : len(words) - width + 1 + i])
    return joined


def simhash(text: bytes, width: int = 2) -> bytes:
    """16 bytes: the signs of the votes of all terms, each weighted by 1 + floor(log2(count))."""
    terms, counts = np.unique(terms_of(words_of(text), width), return_counts=True)
    weights = np.frexp(counts.astype(np.float64))[1].astype(np.float64)
    votes = np.zeros(BITS)
    for at in range(0, len(terms), 1 << 14):
        part = terms[at : at + (1 << 14)]
        halves = np.stack([part, _mixed(part + np.uint64(1))], axis=1)
        bits = np.unpackbits(halves.view(np.uint8).reshape(len(part), BITS // 8), axis=1)
        w = weights[at : at + (1 << 14)]
        votes += 2.0 * (w @ bits) - w.sum()
    return np.packbits(votes > 0).tobytes()
