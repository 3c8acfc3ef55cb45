"""Line dedup by a log-template tree of fixed depth.

A line's path in the tree is its number of tokens, then its first ``LEADING`` tokens.
Its leaf holds templates: the line's tokens, in which those with a digit are variable
fields, and, for lines of at least ``FIELDS`` tokens, up to four more, each of which
generalises one part of the tokens after the leading ones, whatever it holds (a quarter
of them, one token in short lines). So lines of a leaf that differ in one part share a
template. Fields with digits are generalised only in lines with another token, and a
part only where at least half of the line's tokens are left constant.

Leaves are never gathered: a line names its templates by itself, by 64-bit hashes of
path, constant tokens and the part's place, and templates are counted by those. What
would make a leaf's template by one log line after another is thus the same for any
order of lines.

A template recurs if documents with different ids have it. All its lines go, but for
those of the document with the smallest id, where the text stays once. Decisions per
line don't depend on the order or partitioning of rows.

Lines and recurring templates are joined by a shuffle (a template with a thousandth of
all lines is broadcast), and what is found goes back to its rows by doc_id and 128 bits
of the text's hashes; this is the one plan for every size.

Tokens are runs of anything but ASCII white space, A-Z lower-cased. Lines end with a
line feed; lines without tokens are kept, and belong to no template.

Defined cases: a null text has no lines and stays null; an empty one stays empty. Rows
that repeat a doc_id are one document, so they drop nothing of each other. A row with
a null doc_id is left as it is and isn't counted. An empty table gives an empty
result. Other columns are kept by ``drop_recurring`` and ignored by ``find_recurring``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._hot import join_by_count
from ._store import dispose, materialize, small_batches, trimmed

#: Leading tokens on the path to a leaf.
LEADING = 2
#: Tokens from which a line has templates with a generalised part; of fewer, one is more than a fifth of the line.
FIELDS = 5

_WILD = np.uint64(0x6A09E667F3BCC909)
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_BASE = 0x9FB21C651E98DF25
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(max(n, 1 << 18), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines of all rows, the row of each line); an empty row has one empty line.

    A feed at a row's end opens no further line.
    """
    rows = len(offsets) - 1
    feeds = np.flatnonzero(data == 10) + 1
    at = np.searchsorted(offsets, feeds, "left") - 1  # the row that a feed is in
    inside = feeds < offsets[at + 1]
    feeds, at = feeds[inside], at[inside]
    starts, row = np.concatenate([offsets[:-1], feeds]), np.concatenate([np.arange(rows), at])
    order = np.lexsort((starts, row))
    return np.append(starts[order], offsets[-1]), row[order]


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line offsets, row of each line, line of each template, template) of the rows of a chunk."""
    lines, row = line_starts(data, offsets)
    h, line, start, end = W.split_words(data, lines, W.WHITESPACE)
    if not len(h):
        z = np.zeros(0, np.int64)
        return lines, row, z, z.astype(np.uint64)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    wild = digits[end] > digits[start]
    count = np.bincount(line, minlength=len(row))
    wild &= (np.bincount(line[wild], minlength=len(row)) < count)[line]  # not in a line of nothing else
    h = np.where(wild, _WILD, h)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    up, down = _power(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    some = np.flatnonzero(count)
    n, a = count[some], first[some]
    whole = (sums[a + n] - sums[a]) * down[a]
    salt = n.astype(np.uint64) * W._MULT
    at, keys = [some], [W.mix(whole + salt)]
    wilds = np.concatenate([[0], np.cumsum(wild)])
    more = np.flatnonzero(n >= FIELDS)
    n, a, whole, salt = n[more], a[more], whole[more], salt[more]
    free = wilds[a + n] - wilds[a]
    for q in range(4):
        lo, hi = a + LEADING + (n - LEADING) * q // 4, a + LEADING + (n - LEADING) * (q + 1) // 4
        held = n - (hi - lo) - (free - (wilds[hi] - wilds[lo]))  # constant tokens
        ok = np.flatnonzero((hi > lo) & (2 * held >= n))
        at.append(some[more[ok]])
        keys.append(W.mix((whole - (sums[hi] - sums[lo]) * down[a])[ok] + salt[ok] + np.uint64(0xA5A5A5A5 + q)))
    return lines, row, np.concatenate(at), np.concatenate(keys)


def _chunks(batch: pa.RecordBatch, column: int):
    data, offsets = W.string_buffers(batch.column(column))
    for lo, hi in W.chunks(offsets):
        part = offsets[lo : hi + 1]
        yield lo, hi, data[part[0] : part[-1]], part - part[0]


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's templates with the least and greatest doc_id and the number of lines."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in _chunks(batch, 1):
            _, row, line, key = templates(data, offsets)
            if not len(key):
                continue
            doc = ids[lo:hi][row[line]]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(begin[1:], len(key))
            yield pa.record_batch([pa.array(key[begin].view(np.int64)), pa.array(doc[begin]), pa.array(doc[end - 1]), pa.array(end - begin)], names=["template", "first", "last", "lines"])


def recurring_templates(docs: DataFrame) -> DataFrame:
    """(template, first, lines) of the templates that several of ``docs`` (doc_id, text) have."""
    named = docs.where("doc_id is not null").mapInArrow(trimmed(_name), "template long, first long, last long, lines long")
    every = named.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("lines").alias("lines"))
    return every.where("first <> last").select("template", "first", "lines")


def _without(text: bytes, lines: np.ndarray, gone: np.ndarray) -> bytes:
    """A text without some of its lines; lines are its offsets."""
    at = lines.tolist()
    kept = [text[a:b] for a, b, g in zip(at, at[1:], gone.tolist()) if not g]
    out = b"".join(kept)
    return out[:-1] if gone[-1] and out.endswith(b"\n") else out


def _edit(ids: np.ndarray, null: np.ndarray, batch: pa.RecordBatch, column: int, goes_of) -> tuple[list, list, list, list]:
    """New texts with numbers of lines, of recurring and of dropped ones; goes_of judges a chunk."""
    texts, n_lines, n_rec, n_gone = [], [], [], []
    valid = batch.column(column).is_valid().to_numpy(zero_copy_only=False)
    for lo, hi, data, offsets in _chunks(batch, column):
        lines, row, line, key = templates(data, offsets)
        doc = ids[lo:hi][row[line]]
        recurs, goes = goes_of(lo, row, line, key, doc)
        free = null[lo:hi][row]
        recurs, goes = recurs & ~free, goes & ~free
        raw = data.tobytes()
        bounds = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
        sums_r, sums_g = np.concatenate([[0], np.cumsum(recurs)]), np.concatenate([[0], np.cumsum(goes)])
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            s, e = int(offsets[i]), int(offsets[i + 1])
            gone = int(sums_g[b] - sums_g[a])
            text = raw[s:e]
            if gone:
                text = _without(text, np.append(lines[a:b] - s, e - s), goes[a:b])
            texts.append(text.decode() if valid[lo + i] else None)
            n_lines.append((b - a) if e > s else 0)
            n_rec.append(int(sums_r[b] - sums_r[a]))
            n_gone.append(gone)
    return texts, n_lines, n_rec, n_gone


def _rewritten(batch: pa.RecordBatch, columns: int, column: int, counts: tuple[str, str, str], goes_of) -> pa.RecordBatch:
    key = batch.column(columns)
    null = key.is_null().to_numpy(zero_copy_only=False)
    ids = key.fill_null(0).to_numpy(zero_copy_only=False)
    texts, n, r, g = _edit(ids, null, batch, column, goes_of)
    cols = [batch.column(i) if i != column else pa.array(texts, pa.string()) for i in range(columns)]
    names = batch.schema.names[:columns]
    cols += [pa.array(x, pa.int64()) for x in (n, r, g)]
    return pa.RecordBatch.from_arrays(cols, names=[*names, *counts])


def _judge(columns: int, column: int, counts: tuple[str, str, str]):
    """The last columns are the row's key and what a shuffle found of its lines: (line * 2 + does it go)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(columns + 1).to_pylist()

            def goes_of(lo, row, line, key, doc, found=found):
                recurs, goes = np.zeros(len(row), bool), np.zeros(len(row), bool)
                begin = np.searchsorted(row, np.arange(int(row[-1]) + 1)) if len(row) else np.zeros(0, np.int64)
                for i, b in enumerate(begin.tolist()):
                    for x in found[lo + i] or ():
                        recurs[b + (x >> 1)] = True
                        goes[b + (x >> 1)] |= bool(x & 1)
                return recurs, goes

            yield _rewritten(batch, columns, column, counts, goes_of)

    return trimmed(run)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in _chunks(batch, 1):
            _, row, line, key = templates(data, offsets)
            begin = np.searchsorted(row, np.arange(hi - lo))
            h1, h2 = (batch.column(i).to_numpy()[lo:hi][row[line]] for i in (2, 3))
            yield pa.record_batch([pa.array(ids[lo:hi][row[line]]), pa.array(h1), pa.array(h2), pa.array(line - begin[row[line]]), pa.array(key.view(np.int64))], names=["doc_id", "h1", "h2", "line", "template"])


def _text_hashes(text_col: str) -> tuple[Column, Column]:
    """Two hashes that, with its doc_id, tell a row from all rows of another text."""
    text = F.col(text_col).cast("string")
    return F.xxhash64(text), F.xxhash64(F.lit("line dedup"), text)


def _fresh(name: str, columns: list[str]) -> str:
    """A column name that isn't taken yet."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _cleaned(docs: DataFrame, id_col: str, text_col: str, counts: tuple[str, str, str]) -> DataFrame:
    """``docs`` with new texts, and columns named by ``counts``: lines, recurring and dropped ones."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = materialize(recurring_templates(rows), "templates")
    width, column = len(docs.columns), docs.columns.index(text_col)
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString() if f.name != text_col else 'string'}" for f in docs.schema.fields]
    schema = ", ".join([*fields, *(f"`{c}` long" for c in counts)])
    key, ident, marks_col = (_fresh(c, docs.columns) for c in ("__key", "__id", "__marks"))
    keyed = docs.withColumn(key, F.col(id_col).cast("long"))
    h1, h2 = _text_hashes("text")
    hashed = rows.where("doc_id is not null").select("doc_id", "text", h1.alias("h1"), h2.alias("h2"))
    lines = materialize(hashed.mapInArrow(trimmed(_lines), "doc_id long, h1 long, h2 long, line long, template long"), "lines")
    hits = join_by_count(lines, known, ["template"], "lines", lines.count())
    marks = hits.select("doc_id", "h1", "h2", (F.col("line") * 2 + (F.col("first") != F.col("doc_id")).cast("long")).alias("mark"))
    m1, m2 = (_fresh(c, docs.columns) for c in ("__h1", "__h2"))
    found = marks.groupBy("doc_id", "h1", "h2").agg(F.collect_set("mark").alias(marks_col))  # at most two a line of a text
    marks = materialize(found.select(F.col("doc_id").alias(ident), F.col("h1").alias(m1), F.col("h2").alias(m2), marks_col), "marks")
    dispose(lines, known)
    h1, h2 = _text_hashes(text_col)
    joined = keyed.join(marks, (F.col(key) == F.col(ident)) & (h1 == F.col(m1)) & (h2 == F.col(m2)), "left").drop(ident, m1, m2)
    return joined.mapInArrow(_judge(width, column, counts), schema)


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with recurring lines taken from the texts; a row that had text and has none left goes."""
    counts = tuple(_fresh(c, docs.columns) for c in ("n_lines", "n_recurring", "n_dropped"))
    clean = _cleaned(docs, id_col, text_col, counts)
    left = F.coalesce(F.length(F.regexp_replace(F.col(text_col), r"[ \t\n\r\x0b\f]", "")) > 0, F.lit(False))
    return clean.where(left | (F.col(counts[2]) == 0)).select(*docs.columns)


def find_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (without recurring lines), n_lines, n_recurring, n_dropped of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _cleaned(rows, "doc_id", "text", ("n_lines", "n_recurring", "n_dropped"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_recurring", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
