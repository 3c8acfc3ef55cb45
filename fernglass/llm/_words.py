"""Vectorised word splitting and hashing over Arrow string buffers.

A word's hash is a polynomial over randomly mapped bytes modulo 2**64, taken for
all words of a chunk at once from one prefix sum, then finalised with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the working memory of a worker.
CHUNK_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def forget_long() -> None:
    """Lets go of tables that a long text needed."""
    if len(_powers["up"]) > CHUNK_BYTES + 1:
        _powers["up"] = _powers["down"] = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordClass:
    """Which bytes make words, after A-Z are lower-cased."""

    def __init__(self, is_word: np.ndarray):
        lower = np.arange(256)
        lower[65:91] += 32
        self.lower = lower.astype(np.uint8)
        self.is_word = is_word[lower]
        rng = np.random.Generator(np.random.PCG64(20240229))
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.values = values[lower]


def _whitespace_class() -> WordClass:
    ok = np.ones(256, bool)
    ok[[0x20, *range(0x09, 0x0E)]] = False
    return WordClass(ok)


def _alnum_class() -> WordClass:
    ok = np.zeros(256, bool)
    ok[0x30:0x3A] = ok[0x61:0x7B] = ok[0x80:] = True
    return WordClass(ok)


#: Words are maximal runs of anything but ASCII white space.
WHITESPACE = _whitespace_class()
#: Words are maximal runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = _alnum_class()


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; a null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    buffers = arr.buffers()
    n = len(arr)
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def split_words(data: np.ndarray, offsets: np.ndarray, kind: WordClass) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word of the rows of a chunk; offsets start at 0."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    inside = kind.is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(kind.values[data] * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = mix(h + (end - start).astype(np.uint64) * _MULT)
    row = np.searchsorted(offsets, start, "right") - 1
    return h, row, start, end


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two word hashes."""
    return mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)


def single_hash(a: np.ndarray) -> np.ndarray:
    """The hash of a one-word sequence, unlike that of any pair but by chance of 2**-64."""
    return mix(a ^ np.uint64(0x165667B19E3779F9))
