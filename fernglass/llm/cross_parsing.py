"""Language-model scores by Ziv-Merhav cross-parsing against reference text.

A document of n words is factored greedily into phrases that occur in reference text; a
word that the reference lacks is a phrase of its own. With c phrases against m reference
words, and c' phrases of the document's own incremental (LZ78) parsing, its relative
entropy in bits a word is ``(c * log2(m) - c' * log2(c')) / n``: low for text like the
reference.

The reference is all rows of the table, or those that a column marks, but for the
document itself. It grows with the corpus, so no task can hold one automaton of it, and
to show every document every shard of it would take time as documents times reference
text. The states that a document's words reach in that automaton are looked up instead:
a state is the hash of a run of words, and a run leads on from a word if the reference
has it. Rounds ask for ever longer runs, of 2 to 8 words and then of twice as many up to
the longest text, from those words alone
whose run of the round before another document had. In a round tasks send each batch's distinct hashes once,
packed by hash range, with whether the batch offers them, asks for them or both; ranges
return a bit for each that is asked for. What is moved grows as the corpus does. Texts are
split and hashed once; rounds read files of the batches' words.

A phrase is the longest match (one word where none matches), so the factoring is that of
the suffix automaton. The rounds leave it open where a match of more than 8 words ends, but
for a span. No match ends before one that begins further left, which narrows the spans;
those that a factoring can come upon are settled by further rounds (``Settling``): a batch
tells which runs such spans begin with, all that have one of these runs offer it at every
length that a span leaves open, or at ``SPLIT`` of them if it is wider, and so on until no
span is open.

Where ``rounds`` are given, a phrase is the longest match of one of their lengths, and a
longer match several phrases.

Words are runs of anything but ASCII white space, A-Z lower-cased. Hashes of runs are
compared in 40 bits within a range.

Defined cases: a null or word-less text has 0 words and phrases and a null score, as
has every text whose reference has no words; then each word is a phrase. A null mark
is false. Repeated rows are documents of their own, so each is reference to the others;
other columns are ignored. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import parquet
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._store import collect_garbage, dispose, materialize, new_path, remove, shuffle_partitions, size_in_bytes, small_batches, trimmed

#: Rounds of a factoring into phrases of few lengths.
ROUNDS = ((2,), (3,), (4,), (6, 8), (12, 16, 32, 64))
#: Words of the first runs that are looked up for longest matches, by the round in which they are.
SHORT = ((2,), (3,), (4, 5), (6, 7, 8))
#: How many lengths of a wider span are asked for at once.
SPLIT = 128
#: Bytes of text of one batch.
BATCH_BYTES = 4 << 20
#: Bytes of text a hash range.
RANGE_BYTES = 16 << 20

_FORTY = np.uint64(40)
_TOKEN = np.uint64((1 << 40) - 1)


class SuffixAutomaton:
    """All runs of some sequences of integers, as transitions from state 0: what the rounds find, for one process and one text."""

    def __init__(self, sequences: list[list[int]]):
        length, link, trans = [0], [-1], [{}]
        last, mark = 0, -1
        for sequence in sequences:
            for c in [*sequence, mark]:  # a mark of its own ends every sequence
                cur = len(length)
                length.append(length[last] + 1)
                trans.append({})
                link.append(0)
                p = last
                while p >= 0 and c not in trans[p]:
                    trans[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = trans[p][c]
                    if length[p] + 1 == length[q]:
                        link[cur] = q
                    else:
                        clone = len(length)
                        length.append(length[p] + 1)
                        trans.append(trans[q].copy())
                        link.append(link[q])
                        while p >= 0 and trans[p].get(c) == q:
                            trans[p][c] = clone
                            p = link[p]
                        link[q] = link[cur] = clone
                last = cur
            mark -= 1
            last = 0 if not sequence else last
        self.trans = trans

    def phrases(self, words: list[int]) -> int:
        """How many phrases a greedy factoring into longest matches has."""
        trans = self.trans
        root = trans[0]
        state, n = root, 0
        for w in words:
            to = state.get(w)
            if to is None:
                if state is not root:
                    n += 1
                    to = root.get(w)
                if to is None:
                    n += 1
                    state = root
                    continue
            state = trans[to]
        return n + (state is not root)


def own_phrases(words: list[int]) -> int:
    """How many phrases the incremental parsing of a sequence of small integers has."""
    if not words:
        return 0
    m = max(words) + 1
    seen: dict[int, int] = {}
    get = seen.get
    node = last = 0  # nodes are numbered in steps of m
    for w in words:
        k = node + w
        node = get(k)
        if node is None:
            last += m
            seen[k] = last
            node = 0
    return last // m + (node > 0)


def relative_entropy(words: int, phrases: int, own: int, reference: int) -> float | None:
    """Bits a word."""
    if not words or not reference:
        return None
    return (phrases * math.log2(max(2, reference)) - own * math.log2(max(1, own))) / words


class _Text:
    """The words of some texts, with hashes of their runs."""

    def __init__(self, words: np.ndarray, code: np.ndarray, size: np.ndarray):
        self.code = code  # words as places in a list of the distinct ones
        self.words, self.size = words[code], size
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        up, self.down = W._power_tables(len(code) + 1)
        self.sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self.words * up[: len(code)], out=self.sums[1:])

    def runs(self, at: np.ndarray, length: int) -> np.ndarray:
        h = self.sums[at + length]
        h -= self.sums[at]
        h *= self.down[at]
        h += np.asarray(length, np.uint64) * W._MULT
        return W.mix(h)

    @cached_property
    def end(self) -> np.ndarray:
        """Of every word, where its text ends."""
        return np.repeat(self.bounds[1:], self.size)


def _keys(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Hashes as their range and 40 bits."""
    key = (((h >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)) << _FORTY
    return key | h & _TOKEN


def _cut(key: np.ndarray, n_ranges: int) -> list[np.ndarray]:
    """Sorted keys by range."""
    cut = np.append(np.searchsorted(key, np.arange(n_ranges, dtype=np.uint64) << _FORTY), len(key))
    return [key[a:b] for a, b in zip(cut, cut[1:])]


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable argsort and the sorted values: values that hold their places in the lowest bits are sorted, which is faster."""
    bits = len(key).bit_length()
    lost = max(0, int(key.max(initial=0)).bit_length() + bits - 64)
    packed = key << np.uint64(bits) if not lost else key >> np.uint64(lost) << np.uint64(bits)
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << bits) - 1)).view(np.int64)
    if not lost:
        packed >>= np.uint64(bits)
        return order, packed
    there = key[order]
    if (there[1:] < there[:-1]).any():  # keys that differ in the lost bits alone
        order = np.argsort(key, kind="stable")
        there = key[order]
    return order, there


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, stable argsort, where each distinct key begins in it, which of them each key is)."""
    order, there = _order(key)
    fresh = np.ones(len(key), bool)
    fresh[1:] = there[1:] != there[:-1]
    begin = np.flatnonzero(fresh)
    run = np.empty(len(key), np.int32)
    run[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return there[begin], order, begin, run


class Round:
    """What a batch knows of some runs by itself, and what it has to ask: those of ``length`` words from the places ``at`` on."""

    def __init__(self, text: _Text, reference: np.ndarray, at: np.ndarray, length: np.ndarray, n_ranges: int, in_order: bool = False):
        """``in_order``: for each length the places ascend."""
        self.at = at
        self.key, order, begin, self.run = _grouped(_keys(text.runs(at, length), n_ranges))
        of = lambda f, x: f.reduceat(x, begin) if len(begin) else begin
        self.every = bool(reference.all())
        if self.every and in_order:
            first, last = (text.doc[at[order[x]]] for x in (begin, np.append(begin[1:], len(order))[: len(begin)] - 1))
        else:
            doc = text.doc[at[order]]
            first, last = of(np.minimum, doc), of(np.maximum, doc)
        self.shared = first != last  # by several documents of the batch
        # holders: reference documents of the batch, two for more
        if self.every:
            self.holder, self.holders = last, 1 + self.shared.view(np.int8)
        else:
            some, none = reference[doc], np.int32(len(text.size))
            self.holder = of(np.maximum, np.where(some, doc, np.int32(-1)))
            self.holders = np.where(self.holder < 0, 0, 1 + (of(np.minimum, np.where(some, doc, none)) != self.holder))
        self.doc = None if self.every else text.doc[self.at]
        self.reference = None if self.every else reference[self.doc]
        self.asks = np.flatnonzero(self.holders < 2)
        self.n_ranges = n_ranges

    def parts(self, which: np.ndarray) -> list[np.ndarray]:
        """The hashes of some runs by range."""
        return _cut(self.key[which], self.n_ranges)

    def sent(self, file: int, batch: int) -> list[tuple]:
        """What goes to the ranges."""
        each = (self.parts(np.flatnonzero(x)) for x in (self.holders == 0, self.holders == 1, self.holders > 1))
        return [(part, file, batch, part, _split40(a), _split40(b), _split40(c)) for part, (a, b, c) in enumerate(zip(*each)) if len(a) or len(b) or len(c)]

    def answered(self, found: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``known`` by the answers of the ranges."""
        offered, present = [np.zeros(0, bool)], [np.zeros(0, bool)]
        for i, part in enumerate(self.parts(self.asks)):
            if len(part):
                bits = np.unpackbits(np.frombuffer(found[i], np.uint8), count=2 * len(part)).astype(bool)
                offered.append(bits[: len(part)])
                present.append(bits[len(part) :])
        return self.known(np.concatenate(offered), np.concatenate(present))

    def known(self, offered: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is each place's run known, does it stay live), given what other batches offer and hold of the runs that were asked."""
        elsewhere, held = np.zeros(len(self.key), bool), self.shared.copy()
        elsewhere[self.asks] = offered
        held[self.asks] |= present
        if self.every:
            found = (self.shared | elsewhere)[self.run]
            return found, found if np.array_equal(offered, present) else held[self.run]
        here = (self.holders >= 2)[self.run] | ((self.holders == 1)[self.run] & (self.holder[self.run] != self.doc))
        found = here | elsewhere[self.run]
        return found, found | self.reference & held[self.run]


def _split40(key: np.ndarray) -> bytes:
    """40-bit values as a plane of their highest bits, which repeat where they ascend, and two of lower ones."""
    key = key & _TOKEN
    return (key >> np.uint64(24)).astype(np.uint16).tobytes() + (key >> np.uint64(8)).astype(np.uint16).tobytes() + key.astype(np.uint8).tobytes()


def _join40(b: bytes) -> np.ndarray:
    n = len(b) // 5
    high, mid, low = np.frombuffer(b, np.uint16, n), np.frombuffer(b, np.uint16, n, 2 * n), np.frombuffer(b, np.uint8, n, 4 * n)
    return high.astype(np.uint64) << np.uint64(24) | mid.astype(np.uint64) << np.uint64(8) | low


def _open(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))


def _planes(code: np.ndarray) -> bytes:
    """32-bit values as their low halves, and their high ones where some aren't 0."""
    high = (code >> 16).astype(np.uint16)
    return code.astype(np.uint16).tobytes() + (high.tobytes() if high.any() else b"")


def _from_planes(b: bytes, n: int) -> np.ndarray:
    code = np.frombuffer(b, np.uint16, n).astype(np.int32)
    return code | np.frombuffer(b, np.uint16, n, 2 * n).astype(np.int32) << 16 if len(b) > 2 * n else code


def _hashed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """A row for some (id, text, mark) rows: their words' hashes, each once, and all words as places among these."""
    ids, texts, mark = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
    data, offsets = W.string_buffers(texts)
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in W.chunks(offsets):
        part = offsets[lo : hi + 1]
        h, row, _, _ = W.split_words(data[part[0] : part[-1]], part - part[0], W.WHITESPACE)
        words.append(h)
        counts.append(np.bincount(row, minlength=hi - lo))
    size, found = np.concatenate(counts), pa.array(np.concatenate(words)).dictionary_encode()
    mark = mark.to_numpy(zero_copy_only=False)
    cells = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
    cells += [pa.array([x], pa.binary()) for x in (mark.tobytes(), size.tobytes(), found.dictionary.to_numpy().tobytes(), _planes(found.indices.to_numpy()))]
    cells += [pa.array([x], pa.int64()) for x in (int(size[mark].sum()), int(size.max(initial=0)), int((~mark).sum()))]
    return pa.record_batch(cells, names=["ids", "mark", "size", "words", "code", "n", "most", "rest"])


def _hash_words(batch_bytes: int):
    """Batches of (id, text, mark) rows as a row each, with the words of reference rows, words of the longest text and how many rows aren't reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                held.append(batch.slice(lo, 256))
                size += held[-1].column(1).nbytes
                if size >= batch_bytes:
                    yield _hashed(held)
                    held, size = [], 0
        if held:
            yield _hashed(held)

    return trimmed(run)


def _batches(uri: str, ids: bool = False) -> Iterator[tuple[pa.Array | None, _Text, np.ndarray]]:
    """(ids where asked for, words, marks) of a file's batches."""
    where, path = _open(uri)
    with where.open_input_file(path) as f:
        for row in parquet.ParquetFile(f).iter_batches(batch_size=1, columns=["mark", "size", "words", "code", *["ids"] * ids], use_threads=False):
            mark, size, words, code = (row.column(c)[0].as_py() for c in ("mark", "size", "words", "code"))
            size = np.frombuffer(size, np.int64)
            text = _Text(np.frombuffer(words, np.uint64), _from_planes(code, int(size.sum())), size)
            yield row.column("ids").flatten() if ids else None, text, np.frombuffer(mark, bool)


def _answers(path: str, file: int) -> dict[int, dict[int, bytes]]:
    """By batch of a file: the levels before a round (-1) and the answers of its ranges."""
    where, folder = _open(f"{path}/file={file}")
    out: dict[int, dict[int, bytes]] = {}
    for info in where.get_file_info(FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                for batch, part, a in zip(*(c.to_pylist() for c in parquet.ParquetFile(f).read(columns=["batch", "part", "a"]).columns)):
                    out.setdefault(batch, {})[part] = a
    return out


_MOST_LENGTHS = 128
_Rounds = tuple[tuple[int, ...], ...]


def _places(text: _Text, live: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """By length: the live words that have so many up to their text's end."""
    at, each = np.flatnonzero(live), []
    left = text.end[at] - at
    for n in lengths:
        at = at[left >= n]
        left = left[left >= n]
        each.append(at)
    return each


def _round(text: _Text, reference: np.ndarray, live: np.ndarray, lengths: tuple[int, ...], n_ranges: int) -> tuple[Round, list[int]]:
    """(all runs of some lengths from live words on, where each length begins in them)."""
    each = _places(text, live, lengths)
    sizes = [*map(len, each)]
    return Round(text, reference, np.concatenate(each), np.repeat(np.array(lengths), sizes), n_ranges, in_order=True), np.cumsum([0, *sizes]).tolist()


def _packed(level: np.ndarray, held: np.ndarray) -> bytes:
    return level.tobytes() + (b"" if level is held or np.array_equal(level, held) else held.tobytes())


def _unpacked(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    level = np.frombuffer(b, np.uint8, n)
    return level, np.frombuffer(b, np.uint8, n, n) if len(b) > n else level


def _levels(text: _Text, reference: np.ndarray, k: int, rounds: _Rounds, n_ranges: int, found: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """After round k, or before the first: how many of the lengths are known from each word on, and of how many its run stays live.

    A run stays live if it is known, or is another document's and the reference's own, so that it may lead others on.
    """
    if k < 0:
        none = np.zeros(len(text.words), np.uint8)
        return none, none
    level, held = _unpacked(found[-1], len(text.words))
    so_far = sum(map(len, rounds[:k]))
    r, ends = _round(text, reference, held == so_far, rounds[k], n_ranges)
    known, stays = r.answered(found)

    def more(before: np.ndarray, yes: np.ndarray) -> np.ndarray:
        count = before.copy()
        for j, (a, b) in enumerate(zip(ends, ends[1:])):
            at = r.at[a:b][yes[a:b]]
            count[at[count[at] == so_far + j]] += 1
        return count

    same = level is held and known is stays
    level = more(level, known)
    return level, level if same else more(held, stays)


_SENT = "range int, file int, batch int, part int, a binary, b binary, c binary"
_TYPES = [("range", pa.int32()), ("file", pa.int32()), ("batch", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in "abc")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _TYPES)], names=[name for name, _ in _TYPES])


def _ask(k: int, rounds: _Rounds, n_ranges: int, before: str | None):
    """Round k of (file, uri) rows: runs that a batch asks for (a), asks for and offers (b), offers (c), and its levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, uri in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
            found = _answers(before, file) if before else {}
            for i, (_, text, mark) in enumerate(_batches(uri)):
                level, held = _levels(text, mark, k - 1, rounds, n_ranges, found.get(i, {}))
                r, _ = _round(text, mark, held == sum(map(len, rounds[:k])), rounds[k], n_ranges)
                rows = [(i % n_ranges, file, i, -1, _packed(level, held), None, None), *r.sent(file, i)]
                yield _rows(rows)

    return trimmed(run)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash range: two bits for each run that a batch asks for, whether another batch offers it and whether one has it."""
    rows, kept, sent = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["part"] < 0:
                rows.append((0, r["file"], r["batch"], r["part"], r["a"], None, None))
                continue
            kept.append((r["file"], r["batch"], r["part"]))
            sent.append([_join40(r[x]) for x in "abc"])
    if kept:
        asks = [x for a, b, _ in sent for x in (a, b)]
        every = [*asks, *(c for *_, c in sent)]
        is_a = np.repeat(np.arange(len(every)) % 2 == 0, [*map(len, every)])
        is_a[sum(map(len, asks)) :] = False
        keys, _, _, run = _grouped(np.concatenate(every))
        held = np.bincount(run, minlength=len(keys))
        offered = np.bincount(run[~is_a], minlength=len(keys)) if is_a.any() else held
        at = 0
        for (file, number, part), (a, b, _) in zip(kept, sent):
            of, own = run[at : at + len(a) + len(b)], np.repeat([0, 1], [len(a), len(b)])
            at += len(of)
            if len(a):
                order = np.argsort(of)  # as the batch has them
                of, own = of[order], own[order]
            if len(of):
                bits = np.concatenate([offered[of] > own, held[of] > 1])
                rows.append((0, file, number, part, np.packbits(bits).tobytes(), None, None))
    for lo in range(0, len(rows), 500):
        yield _rows(rows[lo : lo + 500])


class Spans:
    """(place, words, width): a run of so many words, and how many lengths from it on it stands for; of these, what is open lies between ``lo`` and ``hi``."""

    _FIELDS = ("at", "words", "width", "lo", "hi")

    def __init__(self, at: np.ndarray, words: np.ndarray, width: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        self.at, self.words, self.width = (np.asarray(x, np.int64) for x in (at, words, width))
        self.lo, self.hi = np.zeros(len(at), np.int64) if lo is None else lo, np.zeros(len(at), np.int64) if hi is None else hi

    def __len__(self) -> int:
        return len(self.at)

    def where(self, which: np.ndarray) -> Spans:
        return Spans(*(getattr(self, x)[which] for x in self._FIELDS))

    def within(self, lo: np.ndarray, hi: np.ndarray) -> Spans:
        return Spans(self.at, self.words, self.width, lo, hi)

    def and_then(self, other: Spans) -> Spans:
        return Spans(*(np.concatenate([getattr(self, x), getattr(other, x)]) for x in self._FIELDS))

    def to_bytes(self) -> bytes:
        return np.concatenate([getattr(self, x) for x in self._FIELDS]).astype(np.int32).tobytes()

    @staticmethod
    def from_bytes(b: bytes) -> Spans:
        return Spans(*np.frombuffer(b, np.int32).astype(np.int64).reshape(len(Spans._FIELDS), -1))

    def step(self, split: int) -> np.ndarray:
        """By how many words the lengths differ that are asked for next."""
        return np.maximum(1, -(-self.width // split))

    def least(self, split: int) -> np.ndarray:
        """The longest of these lengths that needn't be asked for."""
        step = self.step(split)
        return self.words + np.maximum(0, self.lo - self.words) // step * step

    def most(self, end: np.ndarray) -> np.ndarray:
        """The longest length that may be asked for, now or later."""
        return np.minimum(np.minimum(self.hi, self.words + self.width - 1), end[self.at] - self.at)

    def longer(self, end: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
        """(span, words) of the lengths that are asked for next."""
        step, least = self.step(split), self.least(split)
        n = np.maximum(0, (self.most(end) - least) // step)
        span = np.repeat(np.arange(len(n)), n)
        return span, least[span] + (np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n) + 1) * step[span]


def ends_of_matches(text: _Text, level: np.ndarray, lengths: list[int], spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest match from each word on ends, at least and at most, given how many of the lengths are known, and spans."""
    at, end = np.arange(len(level)), text.end
    least, most = np.array([1, *lengths]), np.array([*(n - 1 for n in lengths), 1 << 40])
    lo, hi = np.minimum(least[level] + at, end), np.minimum(most[level] + at, end)
    np.maximum.at(lo, spans.at, spans.at + spans.words)
    np.minimum.at(hi, spans.at, spans.at + spans.words + spans.width - 1)
    # no match ends before one that begins further left; texts lie one after the other
    lo = np.maximum.accumulate(lo)
    hi = np.minimum.accumulate(hi[::-1])[::-1]
    return lo, np.maximum(lo, hi)


def open_places(lo: np.ndarray, hi: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The words at which a phrase may begin whose end isn't known, in order."""
    unknown = np.concatenate([[0], np.cumsum(lo < hi)])
    out: list[int] = []
    for d in np.flatnonzero(unknown[bounds[1:]] > unknown[bounds[:-1]]).tolist():
        a = int(bounds[d])
        n = int(np.searchsorted(unknown[a : int(bounds[d + 1]) + 1], unknown[bounds[d + 1]]))  # all that is open lies before
        to, most = (lo[a : a + n] - a).tolist(), (hi[a : a + n] - a).tolist()
        begins = bytearray(n)  # where phrases may begin
        i, begins[0] = 0, 1
        while i >= 0:
            j, k = to[i], most[i]
            if j < k:
                out.append(a + i)
                k = min(k + 1, n)
                begins[j:k] = b"\1" * (k - j)
            elif j < n:
                begins[j] = 1
            i = begins.find(1, i + 1)
    return np.array(out, np.int64)


class Settling:
    """What a batch knows of its spans: those that it has asked about, which of them are open, and the runs that others' spans may begin with."""

    def __init__(self, text: _Text, mark: np.ndarray, lengths: list[int], split: int, every: bool):
        self.text, self.mark, self.lengths, self.split, self.every = text, mark, lengths, split, every
        self.known: tuple[np.ndarray, np.ndarray] | None = None

    def begin(self, level: np.ndarray, held: np.ndarray) -> None:
        self.level = level
        self.asked = Spans(*np.zeros((3, 0)))
        at = open_places(*self.ends(), self.text.bounds)
        words = np.array([1, *self.lengths])[level[at]]
        self.asked, self.open = Spans(at, words, words), np.ones(len(at), bool)
        self.known = None
        self._note_ends()
        self._all_members(held)

    def _all_members(self, held: np.ndarray) -> None:
        long = [(j, n) for j, n in enumerate(self.lengths, 1) if n >= SHORT[-1][-1]]
        held = held * self.mark[self.text.doc]
        each = [np.flatnonzero(held >= j) for j, _ in long]
        words = np.repeat(np.array([n for _, n in long]), [*map(len, each)])
        self.held, self.members = held, Spans(np.concatenate(each), words, words)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        if self.known is None:
            self.known = ends_of_matches(self.text, self.level, self.lengths, self.asked)
        return self.known

    def _note_ends(self) -> None:
        """Gives what was asked its least and most, from where it begins on."""
        (lo, hi), at = self.ends(), self.asked.at
        self.asked = self.asked.within(lo[at] - at, hi[at] - at)

    def state(self, file: int, batch: int, n_ranges: int) -> list[tuple]:
        """Members are given as levels before the first choice."""
        rest = self.members.to_bytes() if self.held is None else None
        rows = [(-1, _packed(self.level, self.level if self.held is None else self.held)), (-2, self.asked.to_bytes()), (-3, self.open.tobytes()), (-4, rest)]
        return [(batch % n_ranges, file, batch, part, b, None, None) for part, b in rows if b is not None]

    def restore(self, found: dict[int, bytes]) -> None:
        self.level, held = _unpacked(found[-1], len(self.text.words))
        self.asked, self.open = Spans.from_bytes(found[-2]), np.frombuffer(found[-3], bool)
        if -4 in found:
            self.held, self.members = None, Spans.from_bytes(found[-4])
        else:
            self._all_members(held)

    def asking(self) -> Spans:
        """The open spans."""
        return self.asked.where(self.open)

    def want(self, n_ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """(the members' runs, the run of each member)."""
        return _grouped(_short_keys(self.text.runs(self.members.at, self.members.words), n_ranges))[::3]

    def sent(self, file: int, batch: int, n_ranges: int) -> list[tuple]:
        """The members' runs (a), those that open spans begin with (b) and between which lengths these are open (c)."""
        asking = self.asking()
        own, run = _grouped(_short_keys(self.text.runs(asking.at, asking.words), n_ranges))[::3]
        between = _between(run, asking.lo, asking.hi, len(own))
        rows, at = [], 0
        for part, (a, b) in enumerate(zip(_cut(self.want(n_ranges)[0], n_ranges), _cut(own, n_ranges))):
            if len(a) or len(b):
                rows.append((part, file, batch, part, _split24(a), _split24(b), between[:, at : at + len(b)].tobytes()))
            at += len(b)
        return rows

    def choose(self, found: dict[int, bytes], n_ranges: int) -> None:
        """Leaves the members whose run an open span begins with."""
        key, run = self.want(n_ranges)
        some, between = [np.zeros(0, bool)], [np.zeros((2, 0), np.int32)]
        for i, part in enumerate(_cut(key, n_ranges)):
            if len(part):
                n = -(-len(part) // 8)
                some.append(np.unpackbits(np.frombuffer(found[i], np.uint8, n), count=len(part)).astype(bool))
                between.append(np.frombuffer(found[i], np.int32, offset=n).reshape(2, -1) if len(found[i]) > n else between[0])
        yes, (lo, hi) = np.concatenate(some), np.concatenate(between, axis=1).astype(np.int64)
        place = np.cumsum(yes) - 1
        members, run = self.members.where(yes[run]), place[run[yes[run]]]
        hi = hi[run]
        if self.every:  # what is longer than any match is of no use to others
            hi = np.minimum(hi, self.ends()[1][members.at] - members.at)
        self.members, self.held = self._distinct(members.within(lo[run], hi)), None

    def _distinct(self, members: Spans) -> Spans:
        """Of members that can offer the same runs alone those of two documents."""
        most = members.most(self.text.end)
        members, most = members.where(most >= members.lo), most[most >= members.lo]
        h = self.text.runs(members.at, most) + W.mix(members.words.astype(np.uint64))
        order, _ = _order(h)  # members of equal runs are of as many words, and so in the order of their places
        new = np.ones(len(h) + 1, bool)
        new[1:-1] = h[order][1:] != h[order][:-1]
        return members.where(np.sort(order[new[:-1] | new[1:]]))

    def round(self, n_ranges: int) -> tuple[Round, Spans, np.ndarray, np.ndarray]:
        """(the lengthened runs, open spans and members, of which of these each run is, its words)."""
        both = self.asking().and_then(self.members)
        span, words = both.longer(self.text.end, self.split)
        return Round(self.text, self.mark, both.at[span], words, n_ranges), both, span, words

    def learn(self, found: dict[int, bytes], n_ranges: int) -> None:
        """Narrows the open spans to what the ranges answer; members are the lengthened runs, where these stand for several lengths."""
        r, both, span, words = self.round(n_ranges)
        known, stays = r.answered(found)
        n, step, over = int(self.open.sum()), both.step(self.split), both.words + both.width
        reached = both.least(self.split)
        rest = np.flatnonzero((np.arange(len(both)) >= n) & (step > 1) & (reached <= self.text.end[both.at] - both.at) & (reached <= both.hi) & (reached < over))
        longer = reached[rest]
        np.maximum.at(reached, span[known], words[known])
        self.asked.words[self.open] = reached[:n]
        self.asked.width[self.open] = np.minimum(step, over - reached)[:n]
        self.known = None
        more = np.flatnonzero(stays & (span >= n) & (step[span] > 1))
        of = np.concatenate([rest, span[more]])
        longer = np.concatenate([longer, words[more]])
        self.members = Spans(both.at[of], longer, np.minimum(step[of], over[of] - longer))
        self._note_ends()
        self.open = np.isin(self.asked.at, open_places(*self.ends(), self.text.bounds))


def _short_keys(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Keys of 24 bits in a range: runs that are alike in them are all wanted if one is."""
    return _keys(h, n_ranges) & ~np.uint64(0xFFFF << 24)


def _split24(key: np.ndarray) -> bytes:
    return (key >> np.uint64(8)).astype(np.uint16).tobytes() + key.astype(np.uint8).tobytes()


def _join24(b: bytes) -> np.ndarray:
    n = len(b) // 3
    return np.frombuffer(b, np.uint16, n).astype(np.uint64) << np.uint64(8) | np.frombuffer(b, np.uint8, n, 2 * n)


def _between(run: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """The least lo and the greatest hi of each of n runs."""
    out = np.empty((2, n), np.int32)
    out[0], out[1] = np.iinfo(np.int32).max, 0
    np.minimum.at(out[0], run, lo.astype(np.int32))
    np.maximum.at(out[1], run, hi.astype(np.int32))
    return out


def _settle(what: str, k: int, rounds: _Rounds, n_ranges: int, before: str, split: int, every: bool):
    """Further rounds of (file, uri) rows: ``want`` sends the runs that spans begin with and that members have, ``lengthen`` their lengthened runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, uri in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
            found = _answers(before, file)
            for i, (_, text, mark) in enumerate(_batches(uri)):
                here = _settled(text, mark, what, k, rounds, n_ranges, found.get(i, {}), split, every)
                rows = here.state(file, i, n_ranges)
                if what == "want":
                    rows += here.sent(file, i, n_ranges)
                else:
                    rows += here.round(n_ranges)[0].sent(file, i)
                yield _rows(rows)

    return trimmed(run)


def _settled(text: _Text, mark: np.ndarray, what: str, k: int, rounds: _Rounds, n_ranges: int, found: dict[int, bytes], split: int, every: bool) -> Settling:
    """A batch as it is before the k-th time that it sends what it wants or lengthens."""
    here = Settling(text, mark, [*chain.from_iterable(rounds)], split, every)
    if what == "want" and not k:
        here.begin(*_levels(text, mark, len(rounds) - 1, rounds, n_ranges, found))
        return here
    here.restore(found)
    here.choose(found, n_ranges) if what == "lengthen" else here.learn(found, n_ranges)
    return here


def _meet_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash range: a bit for each run that a batch's members have, whether a span begins with it, and between which lengths these spans are open."""
    rows, kept, wanted, open_between = [], [], [np.zeros(0, np.uint64)], [np.zeros((2, 0), np.int32)]
    for batch in batches:
        for r in batch.to_pylist():
            if r["part"] < 0:
                rows.append((0, r["file"], r["batch"], r["part"], r["a"], None, None))
                continue
            kept.append((r["file"], r["batch"], r["part"], _join24(r["a"])))
            if r["b"]:
                wanted.append(_join24(r["b"]))
                open_between.append(np.frombuffer(r["c"], np.int32).reshape(2, -1))
    some, run = np.unique(np.concatenate(wanted), return_inverse=True)
    between = _between(run, *np.concatenate(open_between, axis=1), len(some))
    for file, number, part, keys in kept:
        if len(keys):
            at = np.minimum(np.searchsorted(some, keys), max(0, len(some) - 1))
            yes = some[at] == keys if len(some) else np.zeros(len(keys), bool)
            rows.append((0, file, number, part, np.packbits(yes).tobytes() + between[:, at[yes]].tobytes(), None, None))
    for lo in range(0, len(rows), 500):
        yield _rows(rows[lo : lo + 500])


_SCORE = [("n_words", pa.int64()), ("n_phrases", pa.int64()), ("n_own", pa.int64()), ("ref_words", pa.int64()), ("score", pa.float64())]


def _factor(rounds: _Rounds, settled: int, n_ranges: int, before: str, total: int, split: int, every: bool):
    """Scores, after ``settled`` times of lengthening; without it phrases have the lengths of the rounds."""
    step_of = np.array([1, *chain.from_iterable(rounds)])

    def steps(text: _Text, mark: np.ndarray, found: dict[int, bytes]) -> np.ndarray:
        if not settled:
            return step_of[_levels(text, mark, len(rounds) - 1, rounds, n_ranges, found)[0]]
        here = _settled(text, mark, "want", settled, rounds, n_ranges, found, split, every)
        if here.open.any():
            raise AssertionError("spans are open")
        return here.ends()[0] - np.arange(len(text.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, uri in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))):
            found = _answers(before, file)
            for i, (ids, text, mark) in enumerate(_batches(uri, ids=True)):
                step = steps(text, mark, found.get(i, {}))
                rows, at = [], text.bounds.tolist()
                for d, (a, b) in enumerate(zip(at, at[1:])):
                    own_step, phrases, j = step[a:b].tolist(), 0, 0
                    while j < b - a:
                        j += own_step[j]
                        phrases += 1
                    own = own_phrases(text.code[a:b].tolist())
                    reference = total - (b - a if mark[d] else 0)
                    rows.append((b - a, phrases, own, reference, relative_entropy(b - a, phrases, own, reference)))
                yield pa.record_batch([ids, *(pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(_SCORE))], names=["doc_id", *(n for n, _ in _SCORE)])

    return trimmed(run)


def rounds_up_to(most: int) -> _Rounds:
    """Rounds for longest matches in texts of so many words."""
    long, n = [], 2 * SHORT[-1][-1]
    while n <= most:
        long.append(n)
        n *= 2
    return (*SHORT, *(x for x in (tuple(long[:3]), tuple(long[3:])) if x))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reference: Column | None = None, rounds: _Rounds | None = None, batch_bytes: int = BATCH_BYTES, split: int = SPLIT) -> DataFrame:
    """doc_id, n_words, n_phrases, n_own, ref_words, score of every row; ``reference`` marks the rows that are reference text (all).

    Phrases are longest matches, or those of the lengths in ``rounds``.
    """
    lengths = [*chain.from_iterable(SHORT if rounds is None else rounds)]
    if not all(rounds or SHORT) or not lengths or lengths != sorted(set(lengths)) or lengths[0] < 2 or len(lengths) >= _MOST_LENGTHS or split < 2:
        raise ValueError("lengths ascend from 2 at least")
    spark = docs.sparkSession
    small_batches(spark)
    mark = F.coalesce(reference, F.lit(False)) if reference is not None else F.lit(True)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark.alias("mark"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    words = rows.mapInArrow(_hash_words(batch_bytes), f"ids array<{kind}>, mark binary, size binary, words binary, code binary, n long, most long, rest long")
    # files, so that batches are the same in every round; a row is as large as a batch
    fixed = materialize(words, "words", "zstd", **{"parquet.page.size.row.check.min": "1"})
    n_ranges = max(shuffle_partitions(spark), size_in_bytes(fixed) // RANGE_BYTES)
    total, most, rest = fixed.agg(F.sum("n"), F.max("most"), F.sum("rest")).first()
    total, every = total or 0, not rest
    names = sorted(fixed.inputFiles())
    if not names:
        return rows.select("doc_id", *(F.lit(None).cast(t).alias(n) for n, t in (("n_words", "long"), ("n_phrases", "long"), ("n_own", "long"), ("ref_words", "long"), ("score", "double"))))
    files = spark.createDataFrame([*enumerate(names)], "file int, uri string").repartitionById(len(names), "file")
    sends, settled = [], 0
    if rounds is None:
        rounds = rounds_up_to(most or 0)
        width = rounds[-1][-1]
        while width > 1:
            sends += [("want", settled), ("lengthen", settled)]
            settled, width = settled + 1, max(1, -(-width // split))
    before = None
    for what, k in [*(("ask", k) for k in range(len(rounds))), *sends]:
        ask = _ask(k, rounds, n_ranges, before) if what == "ask" else _settle(what, k, rounds, n_ranges, before, split, every)
        sent = files.mapInArrow(ask, _SENT)
        found = sent.repartitionById(n_ranges, "range").mapInArrow(trimmed(_meet_wanted if what == "want" else _meet), _SENT)
        path = new_path(spark, "round")
        found.select("file", "batch", "part", "a").repartition(min(len(names), n_ranges), "file").write.partitionBy("file").parquet(path)
        if before:
            remove(spark, before)
        before = path
        del sent, found
        collect_garbage(spark)
    return files.mapInArrow(_factor(rounds, settled, n_ranges, before, total, split, every), f"doc_id {kind}, n_words long, n_phrases long, n_own long, ref_words long, score double")
