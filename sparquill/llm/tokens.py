"""Words of many texts at once, as numbers: array work over UTF-8 bytes, no loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes hashed at a time

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors)
    return _powers["up"], _powers["down"]


def text_slices(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) in slices of about ``limit`` bytes.

    Null texts are empty.  A longer text is a slice of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """The row and the 64-bit hash of every word, in order; ``letters`` has the bytes of a word.

    A-Z count as a-z, both in ``letters`` and in the hash.
    """
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    low = LOWER[data]
    inside = letters[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # blocks that end with a word; a very long word is a block of its own
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        a, b = starts[at], ends[to - 1]
        up, down = _power_tables(int(b - a))
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_LETTER[low[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        hashes[at:to] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return np.searchsorted(offsets, starts, side="right") - 1, hashes


def word_hash(word: str) -> int:
    """The hash that ``words`` gives this one word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(words(data, np.array([0, len(data)]))[1][0])
