"""Exact Jaccard self-join over word n-gram sets, by set-relation skipping.

A document's set holds the hashes (64 bits) of its distinct word n-grams. Two
documents link when ``100 * |A & B| >= threshold * |A | B|``. The join is exact:

1. *Shared counts.* A partner covers at least ``threshold`` % of a set and has a size
   within that ratio. So a set in which fewer of the n-grams occur in a document of
   such a size links with nothing. Tasks send each batch's n-grams packed by hash
   range, one alone of those that a batch holds several times; ranges return, by
   document, how many occur elsewhere.
2. *Classes.* Equal sets become one class with a count of members; of the sets that
   pass, one a class goes on.
3. *Prefixes.* A second exchange of that kind tells each set's n-grams that still have
   partners, how frequent they are, and, of those in few batches, in which of ``GROUPS``
   groups of batches. A set can link into those groups alone that have ``threshold`` %
   of its n-grams, and only n-grams of such a group count. Ordered by frequency class
   and hash, the first so many of them that any partner must share one are the set's
   prefix. A first common n-gram at a place of the order bounds the overlap by what
   follows it, hence the sizes of partners (positional filter).
4. *Families.* Along each prefix n-gram's size-ordered list, sets are connected whose
   bounds admit each other and whose groups do; sets of different families can't link.
5. *Tiles.* Families are cut into cells of bounded size, and pairs of cells are
   computed in one task each, to which sets are sent as they are read. Inverted lists
   are ordered by set size and read from the first to the last position whose size can
   link, the rest is skipped; a set much like the one before derives its overlaps from
   that one's by the lists of the n-grams in which they differ.

No pair is ever emitted: a tile returns a count per set and a spanning forest. No
n-gram's list is gathered whole: of a batch it has an entry a size class, or a size
and bound, at most.

Defined cases: a null or word-less text has an empty set, links with nothing and
is its own component. Fewer words than n make one n-gram of them all. Rows that
repeat a doc_id count as one document and each get its n_similar and component_id; of
different texts the one with the least hashes counts. A null doc_id gets n_shingles,
no links and a null component. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._hot import join_by_count, without
from ._store import UNKNOWN_BYTES, collect_garbage, dispose, materialize, shuffle_partitions, size_in_bytes, small_batches, trimmed
from .components import connected_components, star_forest

#: N-grams of one batch of documents (8 bytes each, in a worker's memory).
BATCH_SHINGLES = 1_000_000
#: Bytes of text per hash range.
RANGE_BYTES = 16 << 20
#: N-grams of one cell of a family (8 bytes each); two cells meet in a task.
CELL_SHINGLES = 1_000_000
#: Ids that a broadcast may hold (8 bytes each, and what goes with them); beyond, the join shuffles.
BROADCAST_IDS = 4_000_000
#: The side of a cell that meets itself.
SELF = 2
#: Sets whose lists share one range of positions.
BLOCK = 64
#: Groups of batches that a set may have partners in; a number is one byte.
GROUPS = 256
#: Other entries of a like size up to which an n-gram's groups are told; one with more counts for every group.
LISTED = 16
#: Places of n-grams' lists of groups that are looked at together.
SLICE = 1 << 21
#: Ratio of neighbouring size classes.
CLASS_RATIO = 1.05


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 2) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every row of a chunk."""
    h, row, _, _ = W.split_words(data, offsets, W.WHITESPACE)
    rows = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(rows + 1))
    if n == 1 or len(h) < 2:
        grams = W.single_hash(h)
    else:
        grams = h
        for k in range(1, n):
            grams = W.pair_hash(grams[:-1], h[k:])
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= n:
            s = np.sort(grams[lo : hi - n + 1])
        elif hi > lo:
            whole = W.single_hash(h[lo : lo + 1])
            for k in range(lo + 1, hi):
                whole = W.pair_hash(whole, h[k : k + 1])
            s = whole
        else:
            s = grams[:0]
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        out.append(s)
    return out


def _sets_of(batch: pa.RecordBatch, n: int, column: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = W.string_buffers(batch.column(column))
    for lo, hi in W.chunks(offsets):
        part = offsets[lo : hi + 1]
        for i, s in enumerate(shingle_sets(data[part[0] : part[-1]], part - part[0], n)):
            yield lo + i, s


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    with np.errstate(over="ignore"):
        return int(W.mix(s).sum(dtype=np.uint64).view(np.int64)), int(W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _size_class(n: np.ndarray) -> np.ndarray:
    """Classes of sizes, the last of them open."""
    return np.minimum(np.floor(np.log(np.maximum(n, 1)) / math.log(CLASS_RATIO)), 255).astype(np.uint8)


def _class_reach(threshold: int) -> int:
    """By how much the classes of two sizes within the ratio may differ; the open one is near all."""
    return math.floor(math.log(100 / threshold) / math.log(CLASS_RATIO)) + 1


def _near(token: np.ndarray, size: np.ndarray, reach: int) -> np.ndarray:
    """Which entries, sorted by token and size class, have another of their token within reach."""
    out = np.zeros(len(token), bool)
    close = (token[1:] == token[:-1]) & ((size[1:].astype(np.int64) - size[:-1] <= reach) | (size[1:] == 255))
    out[1:] |= close
    out[:-1] |= close
    return out


def _planes(token: np.ndarray) -> bytes:
    """32-bit values as a plane of high halves, which repeat where they ascend, and one of low halves."""
    return (token >> np.uint32(16)).astype(np.uint16).tobytes() + token.astype(np.uint16).tobytes()


def _unplane(b: bytes) -> np.ndarray:
    n = len(b) // 4
    return (np.frombuffer(b, np.uint16, n).astype(np.uint32) << np.uint32(16)) | np.frombuffer(b[2 * n :], np.uint16, n)


_EIGHT, _FORTY = np.uint64(8), np.uint64(40)


class _Batch:
    """The n-grams of some documents, sorted by hash range, token and size class.

    A token is 32 bits of a hash; n-grams of a range that share one count as the same,
    which makes more candidates and loses none.
    """

    def __init__(self, ids: list, sets: list[np.ndarray], n_ranges: int):
        self.ids = pa.record_batch([pa.array(ids, pa.int64())], names=["i"]).serialize().to_pybytes()
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        h = np.concatenate([np.zeros(0, np.uint64), *sets])
        doc = np.repeat(np.arange(len(sets), dtype=np.uint16), self.size)
        key = (((h >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)) << _FORTY
        key |= (h & np.uint64(0xFFFFFFFF)) << _EIGHT
        key |= _size_class(self.size)[doc]
        order = np.argsort(key, kind="stable")
        self.key, self.doc = key[order], doc[order]
        self.n_ranges = n_ranges

    def token(self, at: np.ndarray | slice) -> np.ndarray:
        return (self.key[at] >> _EIGHT).astype(np.uint32)

    def kind(self, at: np.ndarray | slice) -> np.ndarray:
        return self.key[at].astype(np.uint8)

    def cuts(self, at: np.ndarray) -> list[int]:
        """Where each range begins among the entries at these places."""
        return np.searchsorted(self.key[at] >> _FORTY, np.arange(self.n_ranges + 1, dtype=np.uint64)).tolist()


def _batches(batches: Iterator[pa.RecordBatch], n: int, n_ranges: int) -> Iterator[tuple[int, _Batch, np.ndarray]]:
    """(number, batch, digests of its sets)."""
    base, k, held, sets, ids = TaskContext.get().partitionId() << 24, 0, 0, [], []
    for batch in batches:
        names = batch.column(0).to_pylist()
        for i, s in _sets_of(batch, n):
            sets.append(s)
            ids.append(names[i])
            held += len(s)
            if held >= BATCH_SHINGLES or len(sets) == 65535:
                yield base + k, _Batch(ids, sets, n_ranges), np.array([_digest(s) for s in sets], np.int64)
                k, held, sets, ids = k + 1, 0, [], []
    if sets:
        yield base + k, _Batch(ids, sets, n_ranges), np.array([_digest(s) for s in sets], np.int64)


_PACKED = [("range", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcde")]
_SENT = "range int, batch long, kind int, a binary, b binary, c binary, d binary, e binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PACKED)], names=[name for name, _ in _PACKED])


def _send_counts(n: int, n_ranges: int, reach: int):
    """To each range the entries that the batch can't tell to be shared, with their documents' places, and one of those that it can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b, digests in _batches(batches, n, n_ranges):
            shared = _near(b.key >> _EIGHT, b.key.astype(np.uint8), reach)
            local = np.bincount(b.doc[shared], minlength=len(b.size)).astype(np.int32)
            once = np.flatnonzero(~shared)
            many = np.flatnonzero(shared)
            many = many[np.concatenate([[True], b.key[many[1:]] != b.key[many[:-1]]])] if len(many) else many
            c1, c2 = b.cuts(once), b.cuts(many)
            rows = [(number % n_ranges, number, 1, b.ids, b.size.tobytes(), local.tobytes(), digests.tobytes(), None)]
            for r in range(n_ranges):
                x, y = once[c1[r] : c1[r + 1]], many[c2[r] : c2[r + 1]]
                if len(x) or len(y):
                    rows.append((r, number, 0, _planes(b.token(x)), b.doc[x].tobytes(), b.kind(x).tobytes(), _planes(b.token(y)), b.kind(y).tobytes()))
            yield _packed(rows)

    return trimmed(run)


def _meet_counts(reach: int):
    """Of one hash range: how many entries of each document another document of a like size has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, kind, who, cut, names, rows = [], [], [], [0], [], []
        many, many_kind = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"]:
                    rows.append((0, r["batch"], 1, r["a"], r["b"], r["c"], r["d"], None))
                    continue
                token.append(_unplane(r["a"]))
                who.append(np.frombuffer(r["b"], np.uint16))
                kind.append(np.frombuffer(r["c"], np.uint8))
                many.append(_unplane(r["d"]))
                many_kind.append(np.frombuffer(r["e"], np.uint8))
                names.append(r["batch"])
                cut.append(cut[-1] + len(who[-1]))
        if names:
            key = np.concatenate([*token, *many]).astype(np.uint64) << _EIGHT | np.concatenate([*kind, *many_kind])
            del token, kind, many, many_kind
            order = np.argsort(key, kind="stable")
            key = key[order]
            near = _near(key >> _EIGHT, key.astype(np.uint8), reach)
            shared = np.zeros(len(key), bool)
            shared[order[near]] = True
            for name, w, lo, hi in zip(names, who, cut, cut[1:]):
                count = np.bincount(w[shared[lo:hi]])
                some = np.flatnonzero(count)
                if len(some):
                    rows.append((0, name, 0, some.astype(np.uint16).tobytes(), count[some].astype(np.int32).tobytes(), None, None, None))
        for lo in range(0, len(rows), 2000):
            yield _packed(rows[lo : lo + 2000])

    return trimmed(run)


def _ids_of(b: bytes) -> pa.Array:
    return pa.ipc.read_record_batch(b, pa.schema([("i", pa.int64())])).column(0)


def _sum_counts(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"])
        size, total = np.frombuffer(own["b"], np.int64), np.frombuffer(own["c"], np.int32).astype(np.int64)
        for r in rows:
            if not r["kind"]:
                total[np.frombuffer(r["a"], np.uint16)] += np.frombuffer(r["b"], np.int32)
        digest = np.frombuffer(own["d"], np.int64).reshape(-1, 2)
        maybe = (size > 0) & (100 * total >= threshold * size)
        return pa.table({"doc_id": _ids_of(own["a"]), "n": pa.array(size), "h1": pa.array(digest[:, 0]), "h2": pa.array(digest[:, 1]), "maybe": pa.array(maybe)})

    return run


def _shared_counts(docs: DataFrame, n: int, threshold: int, n_ranges: int) -> DataFrame:
    """(doc_id, n, h1, h2, maybe): maybe is false only where no other document can link."""
    reach = _class_reach(threshold)
    sent = docs.mapInArrow(_send_counts(n, n_ranges, reach), _SENT)
    found = sent.repartitionById(n_ranges, "range").mapInArrow(_meet_counts(reach), _SENT)
    return found.groupBy("batch").applyInArrow(_sum_counts(threshold), "doc_id long, n long, h1 long, h2 long, maybe boolean")


def _send_classes(n: int, n_ranges: int):
    """To each range its distinct (token, size class) entries with their numbers; to the batch itself its documents' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b, _ in _batches(batches, n, n_ranges):
            first = np.flatnonzero(np.concatenate([[True], b.key[1:] != b.key[:-1]])) if len(b.key) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(b.key))).astype(np.uint16)
            cut = b.cuts(first)
            rows = [(number % n_ranges, number, 1, b.ids, b.size.tobytes(), times.tobytes(), b.doc.tobytes(), np.array(cut, np.int64).tobytes())]
            for r in range(n_ranges):
                x = first[cut[r] : cut[r + 1]]
                if len(x):
                    rows.append((r, number, 0, _planes(b.token(x)), b.kind(x).tobytes(), times[cut[r] : cut[r + 1]].tobytes(), None, None))
            yield _packed(rows)

    return trimmed(run)


_ALL = 255


def _group(batch: int) -> int:
    return ((batch >> 24) + 97 * (batch & 0xFFFFFF)) % GROUPS


def _windows(begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The places begin .. begin + width - 1 of every window, one after the other."""
    return np.arange(int(width.sum())) + np.repeat(begin - (np.cumsum(width) - width), width)


def _meet_classes(reach: int):
    """Of one hash range: for each entry its token and a code, 0 where no other set of a like size has it, else 1 and its frequency class.

    With those that aren't 0 go the groups that have other such sets, ``_ALL`` of them for more than ``LISTED`` entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, token, kind, times, names, rows = 0, [], [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"]:
                    rows.append((0, r["batch"], 1, r["a"], r["b"], r["c"], r["d"], r["e"]))
                    continue
                here = r["range"]
                token.append(_unplane(r["a"]))
                kind.append(np.frombuffer(r["b"], np.uint8))
                times.append(np.frombuffer(r["c"], np.uint16))
                names.append(r["batch"])
        if names:
            key, n = np.concatenate(token).astype(np.uint64) << _EIGHT | np.concatenate(kind), np.concatenate(times)
            group = np.repeat(np.array([_group(name) for name in names], np.uint8), [*map(len, token)])
            del kind, times
            order = np.argsort(key, kind="stable")
            key, n, group = key[order], n[order], group[order]
            gram = key >> _EIGHT
            near = _near(gram, key.astype(np.uint8), reach) | (n > 1)
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            run_of = np.diff(np.append(first, len(gram)))
            every = np.repeat(np.add.reduceat(n.astype(np.int64), first), run_of)
            code = np.empty(len(key), np.uint8)
            code[order] = np.where(near, 1 + np.floor(np.log2(every)).astype(np.uint8), 0)
            del every
            # an entry's like sizes are a window of its n-gram's entries
            size, end = key.astype(np.uint8).astype(np.int64), np.repeat(first + run_of, run_of)
            low, high = gram << _EIGHT, np.minimum(size + reach, 255).astype(np.uint64)
            from_, upto = np.empty(len(key), np.int32), np.empty(len(key), np.int32)
            from_[order] = np.where(size == 255, np.repeat(first, run_of), np.searchsorted(key, low | np.maximum(size - reach, 0).astype(np.uint64)))
            upto[order] = np.where(size[end - 1] == 255, end, np.searchsorted(key, low | high, "right"))
            place, several = np.empty(len(key), np.int32), np.empty(len(key), bool)
            place[order], several[order] = np.arange(len(key), dtype=np.int32), n > 1
            del key, gram, near, low, high, size, end, n
            lo = 0
            for name, t in zip(names, token):
                c = code[lo : lo + len(t)]
                at = lo + np.flatnonzero(c)
                lo += len(t)
                width = (upto[at] - from_[at]).astype(np.int64)
                few = width <= LISTED + 1
                told, w = at[few], width[few]
                spots = _windows(from_[told].astype(np.int64), w)
                other = (spots != np.repeat(place[told], w)) | np.repeat(several[told], w)
                many = np.full(len(at), _ALL, np.uint8)
                many[few] = w - ~several[told]
                rows.append((here, name, 0, c.tobytes(), _planes(t[c > 0]), many.tobytes(), group[spots[other]].tobytes(), None))
        for lo in range(0, len(rows), 2000):
            yield _packed(rows[lo : lo + 2000])

    return trimmed(run)


def _admitted(doc: np.ndarray, many: np.ndarray, begin: np.ndarray, groups: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents by groups that may have partners, whether an n-gram counts in one of them), of n-grams sorted by document."""
    everywhere = many == _ALL
    long = np.where(everywhere, 0, many).astype(np.int64)
    free = np.bincount(doc[everywhere], minlength=len(least))
    admitted, counts = np.zeros((len(least), GROUPS), bool), everywhere.copy()
    bounds = np.searchsorted(doc, np.arange(len(least) + 1))
    volume = np.concatenate([[0], np.cumsum(long)])[bounds]
    a = 0
    while a < len(least):
        b = max(a + 1, min(a + 4096, int(np.searchsorted(volume, volume[a] + SLICE, "right")) - 1))
        b = min(b, len(least))
        x, y = bounds[a], bounds[b]
        g = groups[_windows(begin[x:y], long[x:y])]
        d = np.repeat(doc[x:y].astype(np.int64) - a, long[x:y])
        n = np.bincount(d * GROUPS + g, minlength=(b - a) * GROUPS).reshape(-1, GROUPS)
        admitted[a:b] = n + free[a:b, None] >= least[a:b, None]
        hit = np.repeat(np.arange(x, y), long[x:y])[admitted[a:b][d, g]]
        counts[hit] = True
        a = b
    return admitted, counts & admitted.any(axis=1)[doc]


def _prefixes(threshold: int):
    """(gram, n, upto, rep, own, groups, same) of a batch's prefixes: of sets that agree in all but rep, the least stands for all (same)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"])
        size, times, doc, cut = np.frombuffer(own["b"], np.int64), np.frombuffer(own["c"], np.uint16), np.frombuffer(own["d"], np.uint16), np.frombuffer(own["e"], np.int64)
        ids = _ids_of(own["a"]).to_numpy(zero_copy_only=False)
        code, gram, many = np.zeros(len(times), np.uint8), np.zeros(len(times), np.int64), np.zeros(len(times), np.uint8)
        lists = [np.zeros(0, np.uint8)]
        for r in sorted((r for r in rows if not r["kind"]), key=lambda r: r["range"]):
            lo, hi = cut[r["range"]], cut[r["range"] + 1]
            code[lo:hi] = np.frombuffer(r["a"], np.uint8)
            some = code[lo:hi] > 0
            gram[lo:hi][some] = _unplane(r["b"]).astype(np.int64) | r["range"] << 32
            many[lo:hi][some] = np.frombuffer(r["c"], np.uint8)
            lists.append(np.frombuffer(r["d"], np.uint8))
        del rows
        long = np.where(many == _ALL, 0, many).astype(np.int64)
        entry = np.repeat(np.arange(len(times), dtype=np.int32), times)
        held = code[entry] > 0
        doc, entry = doc[held], entry[held]
        order = np.lexsort((gram[entry], code[entry], doc))
        doc, entry = doc[order], entry[order]
        least = -(-threshold * size // 100)  # the overlap that any partner has
        admitted, counts = _admitted(doc, many[entry], (np.cumsum(long) - long)[entry], np.concatenate(lists), least)
        doc, gram = doc[counts], gram[entry[counts]]
        usable = np.bincount(doc, minlength=len(size))
        rank = np.arange(len(doc)) - (np.cumsum(usable) - usable)[doc]
        ahead = usable[doc] - rank  # a partner whose first common n-gram this is has no more in common
        at = np.flatnonzero(rank < (usable - least + 1)[doc])
        doc, gram, ahead = doc[at], gram[at], ahead[at]
        # 100 * ahead >= threshold * (n + m - ahead) bounds a partner's size m, as m * threshold <= 100 * n does
        n = size[doc]
        upto = np.minimum(100 * n // threshold, (100 + threshold) * ahead // threshold - n)
        return _contracted(gram, n, upto, ids[doc], _group(own["batch"]), np.packbits(admitted, axis=1), doc)

    return run


def _contracted(gram: np.ndarray, n: np.ndarray, upto: np.ndarray, rep: np.ndarray, own: int, masks: np.ndarray, doc: np.ndarray) -> pa.Table:
    """doc: the place of a row's groups among masks."""
    kinds, kind = np.unique(np.ascontiguousarray(masks).view(f"V{GROUPS // 8}").ravel(), return_inverse=True) if len(masks) else (masks, doc)
    kind = kind[doc]
    inside = (masks[:, own // 8] >> (7 - own % 8) & 1).astype(bool)[doc]  # others of their own batch aren't their partners
    order = np.lexsort((rep, kind, upto, n, gram))
    gram, n, upto, rep, kind, inside = gram[order], n[order], upto[order], rep[order], kind[order], inside[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (n[1:] != n[:-1]) | (upto[1:] != upto[:-1]) | (kind[1:] != kind[:-1]) | ~inside[1:]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(gram)), 0))
    src, dst = star_forest(rep, rep[first]) if len(rep) else (rep, rep)
    more = src != dst
    src, dst = src[more], dst[more]
    none = pa.nulls(len(src), pa.int64())
    join = lambda a, b: pa.concat_arrays([pa.array(a, pa.int64()), b])
    groups = pa.array([k.tobytes() for k in kinds], pa.binary()).take(pa.array(kind[fresh], pa.int64())) if len(gram) else pa.array([], pa.binary())
    return pa.table(
        {
            "gram": join(gram[fresh], none),
            "n": join(n[fresh], none),
            "upto": join(upto[fresh], none),
            "rep": join(rep[fresh], pa.array(src, pa.int64())),
            "own": pa.array(np.full(int(fresh.sum()) + len(src), own), pa.int32()),
            "groups": pa.concat_arrays([groups, pa.nulls(len(src), pa.binary())]),
            "same": pa.concat_arrays([pa.nulls(int(fresh.sum()), pa.int64()), pa.array(dst, pa.int64())]),
        }
    )


def _prefix_rows(reps: DataFrame, n: int, threshold: int, n_ranges: int) -> DataFrame:
    sent = reps.mapInArrow(_send_classes(n, n_ranges), _SENT)
    found = sent.repartitionById(n_ranges, "range").mapInArrow(_meet_classes(_class_reach(threshold)), _SENT)
    return found.groupBy("batch").applyInArrow(_prefixes(threshold), "gram long, n long, upto long, rep long, own int, groups binary, same long")


def list_edges(gram: np.ndarray, n: np.ndarray, upto: np.ndarray, rep: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all sets of each n-gram's list (sorted by gram and n) that may link with each other.

    A set is a candidate for m if ``n <= upto`` of m and so the other way round. A set
    with ``upto < n`` has smaller partners alone, which aren't of that kind themselves.
    So the others are chained wherever any set's sizes span two neighbours, and each of
    that kind hangs on the first of its span.
    """
    many = np.concatenate([[False], gram[1:] == gram[:-1]])
    many[:-1] |= many[1:]
    gram, n, upto, rep = gram[many], n[many], upto[many], rep[many]
    if not len(gram):
        return rep, rep
    _, group = np.unique(gram, return_inverse=True)
    wide = np.int64(max(n.max(), upto.max()) + 2)
    whole = upto >= n
    key, spot = (group * wide + n)[whole], np.flatnonzero(whole)
    lo = np.searchsorted(key, group * wide + np.where(whole, n, -(-threshold * n // 100)))
    hi = np.searchsorted(key, group * wide + upto, "right")
    some = hi > lo
    cover = np.zeros(len(key) + 1, np.int64)
    np.add.at(cover, lo[some], 1)
    np.add.at(cover, hi[some] - 1, -1)
    chained = np.flatnonzero(np.cumsum(cover)[: max(0, len(key) - 1)] > 0)
    hung = np.flatnonzero(some & ~whole)
    return np.concatenate([rep[spot[chained]], rep[hung]]), np.concatenate([rep[spot[chained + 1]], rep[spot[lo[hung]]]])


def group_edges(gram: np.ndarray, n: np.ndarray, upto: np.ndarray, rep: np.ndarray, own: np.ndarray, masks: np.ndarray, threshold: int, limit: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """``list_edges`` of the sets alone whose groups (own, and as bits those admitted) admit each other; a list of more than ``limit`` looks is taken whole."""
    if not len(gram):
        return rep, rep
    several = np.concatenate([[False], gram[1:] == gram[:-1]])
    several[:-1] |= several[1:]
    gram, n, upto, rep, own, masks = (x[several] for x in (gram, n, upto, rep, own, masks))
    if not len(gram):
        return rep, rep
    _, which = np.unique(gram, return_inverse=True)
    there = np.unique(which * GROUPS + own)  # the groups of each list
    begin = np.searchsorted(there, np.arange(which[-1] + 2) * GROUPS)
    first = np.searchsorted(which, np.arange(which[-1] + 2))
    looks = np.concatenate([[0], np.cumsum(np.diff(first) * np.diff(begin))])
    src, dst, a = [rep[:0]], [rep[:0]], 0
    while a <= which[-1]:
        b = max(a + 1, int(np.searchsorted(looks, looks[a] + limit, "right")) - 1)
        x, y = first[a], first[b]
        if looks[b] - looks[a] > limit:
            found = list_edges(gram[x:y], n[x:y], upto[x:y], rep[x:y], threshold)
        else:
            width = np.diff(begin)[which[x:y]]
            to = there[_windows(begin[which[x:y]], width)] % GROUPS
            row = np.repeat(np.arange(x, y), width)
            ok = (masks[row, to // 8] >> (7 - to % 8).astype(np.uint8) & 1).astype(bool)
            row, to = row[ok], to[ok]
            key = (which[row] * GROUPS + np.minimum(own[row], to)) * GROUPS + np.maximum(own[row], to)
            order = np.lexsort((n[row], key))
            row, to, key = row[order], to[order], key[order]
            if len(key):
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                sides = np.minimum.reduceat(own[row], at) != np.maximum.reduceat(own[row], at)
                both = np.repeat(sides | (key[at] // GROUPS % GROUPS == key[at] % GROUPS), np.diff(np.append(at, len(key))))
                row, key = row[both], key[both]
            found = list_edges(key, n[row], upto[row], rep[row], threshold) if len(key) else (rep[:0], rep[:0])
        src.append(found[0])
        dst.append(found[1])
        a = b
    return np.concatenate(src), np.concatenate(dst)


def _chain(threshold: int):
    """Edges of the lists (rows sorted by gram and n), contracted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 1 << 20
        kept: list[np.ndarray] = []

        def take(rows: list[np.ndarray]) -> None:
            nonlocal src, dst, held
            a, b = group_edges(*rows, threshold)
            src, dst = np.concatenate([src, a]), np.concatenate([dst, b])
            if len(src) > held:
                src, dst = star_forest(src, dst)
                held = max(1 << 20, 2 * len(src))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            rows.append(W.string_buffers(batch.column(5))[0].reshape(-1, GROUPS // 8))
            rows = [np.concatenate([x, y]) for x, y in zip(kept, rows)] if kept else rows
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last list may go on in the next batch
            take([x[:cut] for x in rows])
            kept = [x[cut:] for x in rows]
        if kept:
            take(kept)
        if len(src):
            src, dst = star_forest(src, dst)
            yield pa.record_batch([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return trimmed(run)


class _Cell:
    """The sets of a cell by size, with inverted lists over them."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        sets = [np.frombuffer(g, np.uint64) for _, _, g in rows]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        lead = np.fromiter((s[0] for s in sets), np.uint64, len(sets))
        order = np.lexsort((lead, size))
        self.sets = [sets[i] for i in order]
        self.size = size[order]
        self.rep = np.array([rows[i][0] for i in order], np.int64)
        self.mult = np.array([rows[i][1] for i in order], np.int64)

    def index(self) -> None:
        grams, who = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
        order = np.argsort(grams, kind="stable")
        grams, self.who = grams[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        self.gram, self.begin, self.end = grams[first], first, np.append(first[1:], len(grams))
        # a list's entries ascend in size, so one key finds the first entry of any list at or after a position
        self.key = np.repeat(np.arange(len(first)), self.end - first) * len(self.sets) + self.who

    def overlaps(self, grams: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of grams each of the sets lo..hi-1 holds; list blocks outside are skipped."""
        at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        at = at[self.gram[at] == grams]
        b = np.searchsorted(self.key, at * len(self.sets) + lo)
        e = np.searchsorted(self.key, at * len(self.sets) + hi)
        run = e - b
        total = int(run.sum())
        if not total:
            return np.zeros(hi - lo, np.int64)
        pos = np.arange(total) + np.repeat(b - np.concatenate([[0], np.cumsum(run)[:-1]]), run)
        return np.bincount(self.who[pos] - lo, minlength=hi - lo)


def tile_links(left: _Cell, right: _Cell, threshold: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of left's sets, links of right's sets, component label over both), counted in documents."""
    right.index()
    nl, nr = len(left.sets), len(right.sets)
    count_l, count_r, label = np.zeros(nl, np.int64), np.zeros(nr, np.int64), np.arange(nl + (0 if same else nr))
    shift = 0 if same else nl
    for block in range(0, nl, BLOCK):
        upto = min(nl, block + BLOCK)
        least, most = int(left.size[block]), int(left.size[upto - 1])
        lo = int(np.searchsorted(right.size, -(-threshold * least // 100)))
        hi = int(np.searchsorted(right.size, 100 * most // threshold if threshold else 1 << 62, "right"))
        if hi <= lo:
            continue
        before, known = None, None
        for i in range(block, upto):
            x = left.sets[i]
            if before is not None:
                new, gone = np.setdiff1d(x, before, assume_unique=True), np.setdiff1d(before, x, assume_unique=True)
                if len(new) + len(gone) < len(x) // 2:
                    known = known + right.overlaps(new, lo, hi) - right.overlaps(gone, lo, hi)
                else:
                    known = right.overlaps(x, lo, hi)
            else:
                known = right.overlaps(x, lo, hi)
            before = x
            linked = 100 * known >= threshold * (len(x) + right.size[lo:hi] - known)
            if same and lo <= i < hi:
                linked[i - lo] = False
            found = np.flatnonzero(linked) + lo
            if len(found):
                count_l[i] += right.mult[found].sum()
                if not same:
                    count_r[found] += left.mult[i]
                seen = label[found + shift]
                least_label = min(int(seen.min()), int(label[i]))
                old = np.unique(np.append(seen, label[i]))
                if len(old) > 1:
                    label[np.isin(label, old)] = least_label
    return count_l, count_r, label


def _tiles(threshold: int):
    def done(rows: list[dict]) -> pa.RecordBatch:
        sides = []
        for s in (0, 1, SELF):
            own = {r["rep"]: r for r in rows if r["side"] == s}  # a repeated document's row counts once
            if own:
                sides.append(_Cell([(r["rep"], r["mult"], r["grams"]) for r in own.values()]))
        same = rows[0]["side"] == SELF
        if not same and len(sides) == 1:  # the other cell is empty
            return pa.record_batch([pa.array([], pa.int64())] * 3, names=["rep", "links", "root"])
        left, right = sides[0], sides[-1]
        count_l, count_r, label = tile_links(left, right, threshold, same)
        rep = left.rep if same else np.concatenate([left.rep, right.rep])
        count = count_l if same else np.concatenate([count_l, count_r])
        return pa.record_batch([pa.array(rep), pa.array(count), pa.array(rep[label])], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["tile"] != rows[0]["tile"]:
                    yield done(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield done(rows)

    return trimmed(run)


def _to_tiles(n: int):
    """Sets (doc_id, text, mult, h1, h2, where) as rows of every tile that they go to; texts of other hashes go nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, mult, h1, h2, where = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            rows, held = [], 0
            for i, s in _sets_of(batch, n):
                if (h1[i], h2[i]) != _digest(s):
                    continue
                grams = s.tobytes()
                for w in where[i]:
                    rows.append((w["tile"], w["side"], rep[i], mult[i], grams))
                    held += len(grams)
                    if held > 4 << 20:
                        yield _tile_rows(rows)
                        rows, held = [], 0
            if rows:
                yield _tile_rows(rows)

    return trimmed(run)


def _tile_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["tile", "side", "rep", "mult", "grams"])


def _placed(meta: DataFrame, threshold: int, cell_shingles: int, broadcast_ids: int) -> DataFrame:
    """meta (rep, family, n, ...) with ``where``: the tiles, with sides, to which a set goes."""
    many = meta.groupBy("family").agg(F.sum("n").alias("volume")).where(F.col("volume") > cell_shingles).select("family")
    many = materialize(many, "many")  # a family of several cells has more than cell_shingles n-grams
    many = F.broadcast(many) if many.count() <= broadcast_ids else many
    ratio = F.log(F.col("n")) / math.log(100.0 / threshold + 1e-9) if threshold < 100 else F.col("n")
    large = meta.join(many, "family").withColumn("band", F.floor(ratio).cast("int"))
    large = materialize(large, "large")
    loads = large.groupBy("family", "band").agg(F.ceil(F.sum("n") / cell_shingles).cast("int").alias("parts"))
    cells = loads.select("family", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    a, b = cells.select("family", F.col("band").alias("b1"), F.col("part").alias("p1")), cells.select("family", F.col("band").alias("b2"), F.col("part").alias("p2"))
    meets = a.join(b, "family").where("b2 - b1 in (0, 1) and (b2 > b1 or p2 >= p1)")
    tile = F.xxhash64("family", "b1", "p1", "b2", "p2").alias("tile")
    alone = (F.col("b1") == F.col("b2")) & (F.col("p1") == F.col("p2"))
    first = meets.select("family", F.col("b1").alias("band"), F.col("p1").alias("part"), F.struct(tile, F.when(alone, F.lit(SELF)).otherwise(F.lit(0)).alias("side")).alias("w"))
    second = meets.where(~alone).select("family", F.col("b2").alias("band"), F.col("p2").alias("part"), F.struct(tile, F.lit(1).alias("side")).alias("w"))
    spread = first.unionByName(second).groupBy("family", "band", "part").agg(F.collect_list("w").alias("where"))  # the cells of the next bands
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")
    cut = large.join(loads, ["family", "band"]).select(*meta.columns, "band", part).join(spread, ["family", "band", "part"]).select(*meta.columns, "where")
    small = meta.join(many, "family", "left_anti")
    whole = F.array(F.struct(F.xxhash64("family").alias("tile"), F.lit(SELF).alias("side")))
    return small.select(*meta.columns, whole.alias("where")).unionByName(cut)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, threshold: int = 60, broadcast_ids: int = BROADCAST_IDS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id of every document, for a Jaccard threshold in per cent."""
    if not 1 <= threshold <= 100:
        raise ValueError("threshold is a percentage from 1 to 100")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if size_in_bytes(docs) > UNKNOWN_BYTES:  # written, to know their size
        docs = materialize(docs, "documents")
    n_ranges = max(shuffle_partitions(docs.sparkSession), size_in_bytes(docs) // RANGE_BYTES)
    sizes = materialize(_shared_counts(docs, n, threshold, n_ranges), "sizes")
    collect_garbage(docs.sparkSession)  # after each exchange, so that their files don't add up
    keys = ["h1", "h2", "n"]
    members = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*keys, "maybe")).alias("s")).select("doc_id", "s.*")
    members = materialize(members, "members")
    classes = materialize(members.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.max("maybe").alias("maybe")), "classes")

    some = materialize(classes.where("maybe").select(F.col("rep").alias("doc_id")), "candidates")
    reps = docs.join(F.broadcast(some) if some.count() <= broadcast_ids else some, "doc_id", "left_semi")
    prefix = materialize(_prefix_rows(reps, n, threshold, n_ranges), "prefixes")
    collect_garbage(docs.sparkSession)
    lists = prefix.where("same is null").select("gram", "n", "upto", "rep", "own", "groups").repartition("gram").sortWithinPartitions("gram", "n")
    edges = lists.mapInArrow(_chain(threshold), "src long, dst long").unionByName(prefix.where("same is not null").select(F.col("rep").alias("src"), F.col("same").alias("dst")))
    families = connected_components(edges).select(F.col("id").alias("rep"), F.col("component").alias("family"))
    dispose(prefix, some)

    meta = materialize(families.join(classes, "rep").select("rep", "family", "n", "h1", "h2", "mult"), "families")
    del lists, edges, families
    collect_garbage(docs.sparkSession)
    placed = materialize(_placed(meta, threshold, cell_shingles, broadcast_ids).select(F.col("rep").alias("doc_id"), "mult", "h1", "h2", "where"), "placed")
    placed_few = F.broadcast(placed) if placed.count() <= broadcast_ids // 8 else placed
    tiles = docs.join(placed_few, "doc_id").select("doc_id", "text", "mult", "h1", "h2", "where").mapInArrow(_to_tiles(n), "tile long, side int, rep long, mult long, grams binary")
    linked = materialize(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(threshold), "rep long, links long, root long"), "linked")
    dispose(placed, meta)
    del tiles
    collect_garbage(docs.sparkSession)

    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(linked.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    answers = classes.join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    answers = answers.select(*keys, "mult", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_similar"), F.coalesce("component", "rep").alias("component_id"))
    found = join_by_count(members.where("n > 0"), answers.where("n > 0"), keys, "mult", members.count()).select("doc_id", "n_similar", "component_id")
    return sizes.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("component_id", "doc_id").cast("long").alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, threshold: int = 60) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest doc_id of its component; all columns stay."""
    found = jaccard_groups(docs, id_col, text_col, n, threshold).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
    return without(docs, materialize(found.distinct(), "gone"), id_col)
