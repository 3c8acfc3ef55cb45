"""Benchmark decontamination as a prefix-filtered set join with exact containment.

A benchmark item's windows are its runs of ``window`` consecutive words (an item of
fewer words is one window). A document word is hit if it lies in an occurrence of
any window. The join goes:

1. the benchmark's distinct windows are numbered; each is a set of word pairs
   (shingles; the word itself for a one-word window) at known offsets;
2. one pass over the documents counts the occurrences of the benchmark's shingles
   alone, and orders them by rarity;
3. containment of a whole window needs every shingle of it, so its rarest one is a
   sufficient prefix. Documents probe their shingles against those prefix tokens;
4. the shingle's offset fixes where the window would start: the positional and
   length bounds drop candidates that would leave the document;
5. the rest are verified over the whole window, word by word.

Benchmark tables beyond ``CHUNK_WORDS`` words are spread by hash over chunks of about
that size, long items in overlapping pieces of an eighth of it, and the chunks are
joined one after the other; so what is broadcast is bounded whatever the table's size. What
the chunks find is merged by doc_id and 128 bits of the text's hashes, and given back
as often as that row occurs.

Defined cases: a null or word-less text has n_words 0 and no hits; a null or
word-less item has no window; equal items all count; a repeated item_id is one item
with the windows of all its rows; a null item_id is ignored. Each document row gets
one result row, in repeated rows and for a null doc_id too. Other columns are
ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._hot import without
from ._store import dispose, materialize, small_batches, trimmed

#: Words of benchmark text in one broadcast (about 60 bytes of index each).
CHUNK_WORDS = 1_000_000


def _fold(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of every run of words."""
    out = length.astype(np.uint64)
    for k in range(int(length.max(initial=0))):
        more = length > k
        out[more] = W.pair_hash(out[more], words[start[more] + k])
    return out


class WindowIndex:
    """The distinct windows of some items, found by their rarest shingle; windows are places in the items' words."""

    def __init__(self, names: list[str], texts: list[str], window: int):
        data, offsets = W.string_buffers(pa.array(texts, pa.large_string()))
        self.words, row, _, _ = W.split_words(data, offsets, W.ALNUM)
        n = np.bincount(row, minlength=len(texts))
        first = np.cumsum(n) - n
        length = np.minimum(window, n)
        many = np.where(length > 0, n - length + 1, 0)
        item = np.repeat(np.arange(len(texts)), many)
        start = np.arange(len(item)) - (np.cumsum(many) - many)[item] + first[item]
        length = length[item]
        _, one, window_of = np.unique(_fold(self.words, start, length), return_index=True, return_inverse=True)
        self.window, self.start, self.length = window, start[one], length[one]
        self.names = sorted(set(names))
        place = np.searchsorted(np.array(self.names, object), np.array(names, object)) if names else np.zeros(0, np.int64)
        owner = np.unique(np.stack([window_of, place[item]], axis=1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.owner = owner[:, 1]
        self.owned = np.searchsorted(owner[:, 0], np.arange(len(one) + 1))
        self.shingles = np.unique(np.concatenate([W.single_hash(self.words[self.start[self.length == 1]]), *(self._shingle(j)[1] for j in range(window - 1))]))

    def _shingle(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows of more than j + 1 words, their shingle at j)."""
        some = np.flatnonzero(self.length > j + 1)
        at = self.start[some] + j
        return some, W.pair_hash(self.words[at], self.words[at + 1])

    def names_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.owned[window] : self.owned[window + 1]]]

    def order(self, counts: np.ndarray) -> None:
        """Chooses each window's rarest shingle, by its count in the documents, then by hash."""
        rank = np.empty(len(self.shingles), np.int64)
        rank[np.lexsort((self.shingles, counts))] = np.arange(len(rank))
        best, offset = np.full(len(self.length), len(rank)), np.zeros(len(self.length), np.int64)
        prefix = W.single_hash(self.words[self.start]) if len(self.start) else np.zeros(0, np.uint64)
        for j in range(self.window - 1):
            some, s = self._shingle(j)
            r = rank[np.searchsorted(self.shingles, s)]
            less = r < best[some]
            some = some[less]
            best[some], offset[some], prefix[some] = r[less], j, s[less]
        by = np.argsort(prefix, kind="stable")
        self.token, self.begin = np.unique(prefix[by], return_index=True)
        self.end = np.append(self.begin[1:], len(by))
        self.candidate, self.offset = by, offset[by]


def _sieve(values: np.ndarray) -> np.ndarray:
    """A table by a hash's leading 20 bits: whether any value has them."""
    table = np.zeros(1 << 20, bool)
    table[(values >> np.uint64(44)).astype(np.int64)] = True
    return table


def _lookup(sieve: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the keys that are among the sorted values, their places there)."""
    at = np.flatnonzero(sieve[(keys >> np.uint64(44)).astype(np.int64)])
    if not len(at) or not len(values):
        return at[:0], at[:0]
    to = np.minimum(np.searchsorted(values, keys[at]), len(values) - 1)
    ok = values[to] == keys[at]
    return at[ok], to[ok]


def _chunks_of(batch: pa.RecordBatch, column: int):
    data, offsets = W.string_buffers(batch.column(column))
    for lo, hi in W.chunks(offsets):
        part = offsets[lo : hi + 1]
        h, row, _, _ = W.split_words(data[part[0] : part[-1]], part - part[0], W.ALNUM)
        yield lo, hi, h, row


def _count(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = index.value.shingles
        sieve, total = _sieve(shingles), np.zeros(len(shingles), np.int64)
        for batch in batches:
            for _, _, h, _ in _chunks_of(batch, 0):
                for keys in (W.pair_hash(h[:-1], h[1:]), W.single_hash(h)) if index.value.length.min() == 1 else (W.pair_hash(h[:-1], h[1:]),):
                    total += np.bincount(_lookup(sieve, shingles, keys)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["shingle", "n"])

    return trimmed(run)


def find_windows(ix: WindowIndex, sieve: np.ndarray, h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its first word) of every occurrence in a chunk of documents."""
    doc_end = np.searchsorted(row, np.arange(rows), "right")
    out_w, out_s = [], []
    for keys in (W.pair_hash(h[:-1], h[1:]), W.single_hash(h)) if len(ix.length) and ix.length.min() == 1 else (W.pair_hash(h[:-1], h[1:]),):
        pos, tok = _lookup(sieve, ix.token, keys)
        n = ix.end[tok] - ix.begin[tok]
        pos = np.repeat(pos, n)
        c = np.repeat(ix.begin[tok] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(int(n.sum()))
        win, start = ix.candidate[c], pos - ix.offset[c]
        end = start + ix.length[win]
        ok = start >= 0
        ok[ok] = (row[start[ok]] == row[pos[ok]]) & (end[ok] <= doc_end[row[pos[ok]]])
        win, start = win[ok], start[ok]
        for k in range(ix.window):
            longer = ix.length[win] > k
            ok = ~longer
            ok[longer] = h[start[longer] + k] == ix.words[ix.start[win[longer]] + k]
            win, start = win[ok], start[ok]
        out_w.append(win)
        out_s.append(start)
    return np.concatenate(out_w), np.concatenate(out_s)


def _match(index, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: WindowIndex = index.value
        sieve = _sieve(ix.token)
        for batch in batches:
            n_words, n_hit, items, where = [], [], [], []
            for lo, hi, h, row in _chunks_of(batch, 1):
                rows = hi - lo
                words = np.bincount(row, minlength=rows)
                first = np.concatenate([[0], np.cumsum(words)[:-1]])
                n_words += words.tolist()
                got: list[list[str]] = [[] for _ in range(rows)]
                runs: list[list] = [[] for _ in range(rows)]
                hits = np.zeros(rows, np.int64)
                win, start = find_windows(ix, sieve, h, row, rows)
                if len(win):
                    edge = np.zeros(len(h) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + ix.length[win], -1)
                    inside = np.cumsum(edge[:-1]) > 0
                    hits = np.bincount(row[inside], minlength=rows)
                    for r, w in set(zip(row[start].tolist(), win.tolist())):
                        got[r] += ix.names_of(w)
                    if spans:
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                        for s, e in zip(turn[::2].tolist(), turn[1::2].tolist()):
                            while s < e:  # a run never crosses documents
                                stop = min(e, int(first[row[s]] + words[row[s]]))
                                runs[row[s]].append({"start": s - int(first[row[s]]), "end": stop - int(first[row[s]])})
                                s = stop
                n_hit += hits.tolist()
                items += [sorted(set(g)) for g in got]
                where += runs
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            if spans:
                cols += [pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column(2), batch.column(3)]
            yield pa.record_batch(cols, names=["doc_id", "n_words", "n_hit", "items", "spans", "h1", "h2"][: len(cols)])

    return trimmed(run)


def _pieces(window: int, words: int):
    """(item, text, words) of items cut into pieces of so many words that overlap by a window less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data, offsets = batch.column(0).to_pylist(), *W.string_buffers(batch.column(1))
            for i, name in enumerate(names):
                text = data[offsets[i] : offsets[i + 1]]
                _, _, start, end = W.split_words(text, np.array([0, len(text)]), W.ALNUM)
                last = max(1, len(start) - window + 1)
                at = [(lo, min(len(start), lo + words + window - 1)) for lo in range(0, last, words)] if len(start) else []
                if at:
                    yield pa.record_batch([pa.array([name] * len(at)), pa.array([text[start[a] : end[b - 1]].tobytes().decode() for a, b in at]), pa.array([b - a for a, b in at], pa.int64())], names=["i", "t", "n"])

    return trimmed(run)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings) of every document row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("decontam"), "text").alias("h2"))
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null")
    cut = materialize(items.mapInArrow(_pieces(window, max(1, chunk_words // 8)), "i string, t string, n long"), "items")
    chunks = max(1, math.ceil((cut.agg(F.sum("n")).first()[0] or 0) / chunk_words))
    items = cut.withColumn("chunk", F.pmod(F.xxhash64("i", "t"), F.lit(chunks)))
    parts: list[DataFrame] = []
    for chunk in range(chunks):
        own = items.where(F.col("chunk") == chunk).select("i", "t").toArrow()  # about chunk_words
        ix = WindowIndex(own.column(0).to_pylist(), own.column(1).to_pylist(), window)
        counts = np.zeros(len(ix.shingles), np.int64)
        if len(counts):
            asked = spark.sparkContext.broadcast(ix)
            seen = docs.select("text").mapInArrow(_count(asked), "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()  # at most a row a shingle of the chunk
            counts[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
            asked.destroy()
        ix.order(counts)
        spans = chunks > 1
        schema = f"doc_id {id_type}, n_words long, n_hit long, items array<string>" + ", spans array<struct<start: long, end: long>>, h1 long, h2 long" * spans
        shared = spark.sparkContext.broadcast(ix)
        found = (hashed if spans else docs).mapInArrow(_match(shared, spans), schema)
        if spans:
            found = materialize(found.withColumn("once", F.lit(int(chunk == 0))), "spans")
            shared.destroy()
        parts.append(found)
    dispose(cut)
    if len(parts) == 1:
        return parts[0]
    # several chunks: a row's spans from all of them, merged on its side; equal rows are merged once and counted by the first chunk
    every = reduce(DataFrame.unionByName, parts)
    merged = every.groupBy("doc_id", "h1", "h2").agg(
        F.max("n_words").alias("n_words"),
        F.sum("once").alias("rows"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), x.end - F.greatest(acc.upto, x.start))).alias("n"), F.greatest(acc.upto, x.end).alias("upto"))
    found = merged.select("doc_id", "n_words", F.aggregate("s", zero, step, lambda acc: acc.n).alias("n_hit"), "items", "rows")
    again = found.where("rows > 1").withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("rows")))).drop("copy")
    return found.unionByName(again).drop("rows")


def is_contaminated(share: int = 20):
    """Whether at least one in ``share`` of a document's words is hit."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame, share: int = 20) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(share).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; all columns stay. A row with a null id stays."""
    bad = contamination(docs, benchmark, id_col, text_col, window=window).where(is_contaminated(share)).select(F.col("doc_id").alias(id_col))
    return without(docs, materialize(bad.where(F.col(id_col).isNotNull()).distinct(), "contaminated"), id_col)
