"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

Works for a ``tokenizers`` file of the word-end BPE kind: NFC, white space made one
blank, lower case; pre-tokens by ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``;
white space dropped. Each pre-token's number of ids doesn't depend on its
neighbours, so a text's count is a sum over its pre-tokens.

Texts become arrays of code-point classes, from which pre-tokens are cut and hashed
(64 bits) all at once. Tier one is a compact open-addressing table from the hash of a
frequent pre-token to its number of ids, broadcast; its size is bounded by
``TABLE_TOKENS``. Tier two is each worker's bounded cache; what it misses, the library
encodes, each distinct pre-token of a batch once. The table is counted over a bounded
sample of ``SAMPLE_TEXTS`` texts, drawn from all of them; it alters speed alone, never a
count.

Strings of special tokens in a text count one each, as the library has it, and the
parts between them stand alone. Code points whose normal form needs more than lower
case go through the library's own normaliser, whole texts at once.

Defined cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are
counted whole; each row gives one row, whatever repeats; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import UNKNOWN_BYTES, size_in_bytes, small_batches, trimmed
from ._unicode import APOSTROPHE, NUMBER, OTHER, SPACE, WHITE, class_table

#: Frequent pre-tokens of the broadcast table (9 bytes a slot, at most half of them filled).
TABLE_TOKENS = 1 << 16
#: Texts, of at most SAMPLE_CHARS each, over which frequent pre-tokens are counted, and bytes of the rows from which they are taken, in expectation.
SAMPLE_TEXTS = 1000
SAMPLE_BYTES = 4 << 20
SAMPLE_CHARS = 1 << 16
#: Pre-tokens that a worker's cache may hold.
CACHE_TOKENS = 500_000
#: Characters of text handled at once.
CHUNK_CHARS = 1 << 19

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PROBES = 8


class LengthTable:
    """Hashes to small numbers: an open-addressing table with linear probing."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        bits = max(4, int(2 * max(1, len(hashes)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((1 << bits) + _PROBES, np.uint64)
        self.values = np.zeros((1 << bits) + _PROBES, np.uint8)
        for h, n in zip(hashes.tolist(), lengths.tolist()):
            at = h >> (64 - bits)
            for i in range(at, at + _PROBES):
                if not self.values[i]:
                    if 0 < n < 256:
                        self.keys[i], self.values[i] = h, n
                    break

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's number, 0 where it isn't in the table."""
        at = (hashes >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.values[at], np.uint8(0))
        left = np.flatnonzero((out == 0) & (self.values[at] > 0))
        for p in range(1, _PROBES):
            if not len(left):
                break
            spot = at[left] + p
            hit = self.keys[spot] == hashes[left]
            out[left[hit]] = self.values[spot[hit]]
            left = left[~hit & (self.values[spot] > 0)]
        return out


class TokenCounter:
    """Counts tokens of texts by a tokenizer file; one per worker."""

    def __init__(self, path: str, cache_tokens: int = CACHE_TOKENS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        kinds = [x.get("type") for x in config["normalizer"].get("normalizers", [])]
        splits = config["pre_tokenizer"].get("pretokenizers", [{}])
        if kinds != ["NFC", "Replace", "Lowercase"] or splits[0].get("pattern", {}).get("Regex") != _PATTERN or not splits[0].get("invert") or splits[0].get("behavior") != "Removed":
            raise ValueError("the file's normalisation or pre-tokenisation is of another kind")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        specials = [t["content"] for t in config["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.hints = sorted({s[:2] for s in specials})
        classes = class_table()
        classes[classes == APOSTROPHE] = OTHER
        classes[classes == SPACE] = WHITE
        self.classes = classes
        self.values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.cache: dict[int, int] = {}
        self.cache_tokens = cache_tokens

    def normalise(self, text: str) -> str:
        if text.isascii() or max(text) < "̀":  # no combining marks, and nothing with another normal form
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def parts(self, text: str) -> tuple[list[str], int]:
        """(texts between special strings, number of special strings)."""
        if self.special is None or not any(h in text for h in self.hints):
            return [text], 0
        found = self.special.split(text)
        return found, len(found) - 1

    def pre_tokens(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts normalised, hash, start, end, place of its text) of every pre-token."""
        texts = [self.normalise(t) for t in texts]
        whole = "".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(codes)
        if not n:
            z = np.zeros(0, np.int64)
            return whole, np.zeros(0, np.uint64), z, z, z
        first = np.zeros(n + 3, bool)
        first[ends] = True
        first[0] = True
        kind = self.classes[codes]
        cut = np.empty(n + 1, bool)
        cut[0] = cut[n] = True
        cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | (kind[1:] == WHITE)
        cut |= first[: n + 1]
        quote = np.flatnonzero(codes == 39)
        quote = quote[cut[quote]]  # others are within a run of punctuation
        if len(quote):
            pad = np.concatenate([codes, np.zeros(2, codes.dtype)])
            a, b = pad[quote + 1], pad[quote + 2]
            one = ~first[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
            two = ~first[quote + 1] & ~first[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            cut[quote[one | two] + 1] = False
            for k, which in ((2, one), (3, two)):
                cut[quote[which] + k] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        keep = kind[start] != WHITE
        start, end = start[keep], end[keep]
        up, down = W._power_tables(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[codes] * up[:n], out=sums[1:])
        h = W.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * W._MULT)
        return whole, h, start, end, np.searchsorted(ends, start, "right")

    def count(self, texts: list[str], table: LengthTable) -> np.ndarray:
        """Tokens of every text."""
        pieces, owner = [], []
        total = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found, special = self.parts(t)
            total[i] = special
            pieces += found
            owner += [i] * len(found)
        whole, h, start, end, place = self.pre_tokens(pieces)
        n = table.lookup(h).astype(np.int64)
        missed = np.flatnonzero(n == 0)
        if len(missed):
            unique, one, back = np.unique(h[missed], return_index=True, return_inverse=True)
            n[missed] = self._missed(unique.tolist(), missed[one], whole, start, end)[back]
        total += np.bincount(np.array(owner, np.int64)[place], weights=n, minlength=len(texts)).astype(np.int64)
        return total

    def _missed(self, hashes: list[int], at: np.ndarray, whole: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        got = [self.cache.get(h, 0) for h in hashes]
        new = [i for i, n in enumerate(got) if not n]
        if new:
            if len(self.cache) + len(new) > self.cache_tokens:  # the older half goes
                for k in list(islice(self.cache, len(self.cache) // 2)):
                    del self.cache[k]
            a, b = start[at].tolist(), end[at].tolist()
            for i, n in zip(new, self.lengths([whole[a[i] : b[i]] for i in new])):
                got[i] = self.cache[hashes[i]] = n
        return np.array(got, np.int64)

    def lengths(self, tokens: list[str]) -> list[int]:
        """How many ids the library gives each pre-token."""
        return [len(e.ids) for e in self.library.encode_batch_fast(tokens, add_special_tokens=False)]


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """This process's counter for a file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def frequent_lengths(texts: list[str], path: str, table_tokens: int = TABLE_TOKENS) -> LengthTable:
    """The table of the most frequent pre-tokens of some texts."""
    c = counter(path)
    seen: Counter = Counter()
    name: dict[int, str] = {}
    for lo, hi in groups(texts):
        pieces = [p for t in texts[lo:hi] for p in c.parts(t)[0]]
        whole, h, start, end, _ = c.pre_tokens(pieces)
        unique, one, n = np.unique(h, return_index=True, return_counts=True)
        for k, i, m in zip(unique.tolist(), one.tolist(), n.tolist()):
            seen[k] += m
            if k not in name:
                name[k] = whole[start[i] : end[i]]
    top = [k for k, _ in seen.most_common(table_tokens)]
    return LengthTable(np.array(top, np.uint64), np.array(c.lengths([name[k] for k in top]), np.int64))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", table_tokens: int = TABLE_TOKENS, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = size_in_bytes(rows)
    drawn = rows.sample(min(1.0, SAMPLE_BYTES / max(1, size)), seed=4) if size < UNKNOWN_BYTES else rows
    sample = drawn.where(F.length("text").between(1, SAMPLE_CHARS)).select("text").orderBy(F.xxhash64("text")).limit(sample_texts).collect()
    table = rows.sparkSession.sparkContext.broadcast(frequent_lengths([r[0] for r in sample], path, table_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.concatenate([c.count(texts[lo:hi], table.value) for lo, hi in groups(texts)]) if texts else np.zeros(0, np.int64)
            size = np.diff(W.string_buffers(batch.column(1))[1])
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
