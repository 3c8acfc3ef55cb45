"""Byte-level BPE encoding and decoding by a rank file, with vectorised pre-tokenisation.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
is run without a regex engine. Texts become arrays of code-point classes, and a
nine-state automaton over them tells where pieces begin. Its transition functions
are composed by an associative scan: within rows of ``ROW`` characters column by
column for all rows at once, then across rows by doubling; a second sweep gives
every character its state. Pieces are slices of the text, merged pair by pair
(lowest rank first, leftmost of equals) through a bounded cache of each worker.

Defined cases: a null or empty text has no ids and decodes to no bytes; any length
of text and of piece is encoded whole (long pieces merge through a heap). Each row
gives one row, whatever repeats; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, trimmed
from ._unicode import APOSTROPHE, LETTER, NUMBER, OTHER, SPACE, WHITE, class_table

#: Characters per row of the scan.
ROW = 64
#: Characters of text handled at once.
CHUNK_CHARS = 1 << 19
#: Pieces that a worker's cache may hold.
CACHE_PIECES = 150_000
#: Bytes of a piece from which merging goes through a heap.
LONG_PIECE = 256

#: Bytes of a piece up to which pieces of one length merge in lockstep.
_LOCKSTEP = 40
_NONE = np.int32(2**31 - 1)

_START, _SP, _WS, _LET, _NUM, _PUN, _ONE, _TWO, _END = range(9)
_A2, _A3 = 6, 7  # an apostrophe followed by a contraction of one or two letters
_STATES, _WIDTH = 9, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece begin here) by symbol * 16 + state; symbols from 8 begin a text."""
    step = np.zeros((16, _WIDTH), np.uint8)
    begin = np.zeros((16, _WIDTH), bool)
    for s in range(_STATES):
        glued = s in (_PUN, _SP)
        for sym, to, cut in (
            (OTHER, _PUN, not glued), (APOSTROPHE, _PUN, not glued), (SPACE, _SP, s not in (_SP, _WS)), (WHITE, _WS, s not in (_SP, _WS)),
            (LETTER, {_ONE: _END, _TWO: _ONE}.get(s, _LET), s not in (_LET, _SP, _ONE, _TWO)), (NUMBER, _NUM, s not in (_NUM, _SP)),
            (_A2, _PUN if glued else _ONE, not glued), (_A3, _PUN if glued else _TWO, not glued),
        ):
            step[sym, s], begin[sym, s] = to, cut
    step[8:, :] = step[:8, [_START]]
    begin[8:, :] = True
    return step.ravel(), begin.ravel()


_STEP, _BEGIN = _tables()
_KINDS = np.array([_START, _SP, _ONE, _TWO], np.uint8)
_KIND_OF = np.array([0, 1, 0, 0, 0, 1, 2, 3, 0], np.int64)


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by an associative scan of transition functions."""
    n = len(symbols)
    rows = -(-n // ROW)
    grid = np.zeros(rows * ROW, np.uint16)
    grid[:n] = symbols
    grid = (grid * _WIDTH).reshape(rows, ROW).T.copy()
    # a function is told by its values on one state of each kind that symbols tell apart
    whole = np.repeat(_KINDS, rows).reshape(len(_KINDS), rows)
    for column in grid:
        whole = _STEP.take(column + whole)
    d = 1
    while d < rows:  # inclusive scan over rows: first the earlier function, then the later one
        whole[:, d:] = np.take_along_axis(whole[:, d:], _KIND_OF[whole[:, :-d]], axis=0)
        d *= 2
    state = np.concatenate([[_START], whole[0, :-1]]).astype(np.uint8)
    out = np.empty((ROW, rows), np.uint8)
    for j, column in enumerate(grid):
        out[j] = state
        state = _STEP.take(column + state)
    return out.T.ravel()[:n]


def piece_starts(codes: np.ndarray, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points; text_starts are the places of non-empty texts' first ones."""
    n = len(codes)
    sym = classes[codes]
    first = np.zeros(n + 2, bool)
    first[text_starts] = True
    first[n:] = True
    white = (sym == SPACE) | (sym == WHITE)
    quote = np.flatnonzero(sym == APOSTROPHE)
    if len(quote):
        pad = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = pad[quote + 1], pad[quote + 2]
        inside = ~first[quote + 1]
        one = inside & np.isin(a, [ord(c) for c in "stmd"])
        two = inside & ~first[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        sym[quote[one]] = _A2
        sym[quote[two]] = _A3
    sym[text_starts] += 8
    before = states_before(sym)
    begin = _BEGIN[sym.astype(np.uint16) * _WIDTH + before]
    # the last of several white-space characters stands apart if something follows it in the text
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= ~first[1 : n + 1]
    begin |= last & ((before == _SP) | (before == _WS))
    return np.flatnonzero(begin)


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece: the lowest-ranked adjacent pair merges first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) >= LONG_PIECE:
        return _merge_long(piece, ranks)
    none = 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while rank:
        least = min(rank)
        if least == none:
            break
        i = rank.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], none)
    return tuple([ranks[p] for p in parts])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(piece)
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], nxt[i] = stop, nxt[j]
        alive[j] = 0
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return tuple(out)


class PairTable:
    """Ranks of adjacent ids, for merging many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.single = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of pieces of one length, merged in lockstep."""
        n, width = len(pieces), len(pieces[0])
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8).reshape(n, width)]
        out: list[tuple[int, ...]] = [()] * n
        who = np.arange(n)
        if width > 1:
            rank = self.rank(ids[:, :-1], ids[:, 1:])
            while width > 1:
                at = rank.argmin(axis=1)
                low = rank[np.arange(len(who)), at]
                done = low == _NONE
                if done.any():
                    for i, row in zip(who[done].tolist(), ids[done].tolist()):
                        out[i] = tuple(row)
                    go = ~done
                    who, ids, rank, at, low = who[go], ids[go], rank[go], at[go], low[go]
                    if not len(who):
                        return out
                every = np.arange(len(who))
                ids[every, at] = low
                keep = np.arange(width - 1)
                keep = keep + (keep > at[:, None])
                ids = np.take_along_axis(ids, keep, axis=1)
                width -= 1
                if width == 1:
                    break
                keep = np.minimum(keep[:, : width - 1], width - 1)
                rank = np.take_along_axis(rank, keep, axis=1)
                left, right = at > 0, at < width - 1
                rank[every[left], at[left] - 1] = self.rank(ids[every[left], at[left] - 1], low[left])
                rank[every[right], at[right]] = self.rank(low[right], ids[every[right], at[right] + 1])
        for i, row in zip(who.tolist(), ids.tolist()):
            out[i] = tuple(row)
        return out

    def merge_all(self, pieces: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                yield piece, (whole,)
            elif len(raw) > _LOCKSTEP:
                yield piece, merge_pairs(raw, self.ranks)
            else:
                names, raws = by_length.setdefault(len(raw), ([], []))
                names.append(piece)
                raws.append(raw)
        for names, raws in by_length.values():
            yield from zip(names, self.merge(raws))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes texts and decodes ids by a file of ranks."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.ranks = load_ranks(path)
        self.classes = class_table()
        self.pairs = PairTable(self.ranks)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_pieces = cache_pieces
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes[i] = b
        self.n_bytes = np.fromiter(map(len, self.bytes), np.int32, len(self.bytes))

    def pieces(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """(pieces of all texts, each text's end among them)."""
        whole = "".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not whole:
            return [], [0] * len(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], ends[:-1]])
        starts = piece_starts(codes, begins[begins < ends], self.classes)
        at = starts.tolist()
        return [whole[a:b] for a, b in zip(at, [*at[1:], len(whole)])], np.searchsorted(starts, ends).tolist()

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces, ends = self.pieces(texts)
        if len(self.cache) > self.cache_pieces:  # the older half goes
            for k in list(islice(self.cache, len(self.cache) // 2)):
                del self.cache[k]
        self.cache.update(self.pairs.merge_all(list(set(pieces).difference(self.cache))))
        get, lo, out = self.cache.__getitem__, 0, []
        for hi in ends:
            out.append(list(chain.from_iterable(map(get, pieces[lo:hi]))))
            lo = hi
        return out

    def offsets(self, ids: list[int]) -> np.ndarray:
        """The byte at which each id's bytes begin in the text."""
        n = self.n_bytes[ids] if len(ids) else np.zeros(0, np.int32)
        return np.cumsum(n, dtype=np.int64) - n

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK_CHARS or i - lo >= 4096:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _run(path: str, want: tuple[str, ...], cache_pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, cache_pieces)  # for this task alone: workers stay, idle too
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _groups(texts):
                ids = enc.encode(texts[lo:hi])
                size = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(size[-1]))
                made = {"ids": lambda: pa.ListArray.from_arrays(pa.array(size), pa.array(flat)), "offsets": lambda: pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([enc.offsets(i) for i in ids]))), "decoded": lambda: pa.array([enc.decode(i) for i in ids], pa.binary())}
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(made[w]() for w in want)], names=["doc_id", *want])

    return trimmed(run)


_TYPES = {"ids": "array<int>", "offsets": "array<long>", "decoded": "binary"}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", want: tuple[str, ...] = ("ids", "offsets"), cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """doc_id with ids, offsets (first byte of each id) and, if wanted, decoded (the bytes that the ids give)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{w} {_TYPES[w]}" for w in want)])
    return docs.mapInArrow(_run(path, want, cache_pieces), schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded, the bytes of each row's ids; null ids decode to no bytes, an unknown id raises."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([enc.decode(i or []) for i in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    made = encode(docs, path, id_col, text_col, want=("ids", "decoded"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
