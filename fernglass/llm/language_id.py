"""Language identification, word first, with back-off to shorter character n-grams.

Each language has a table of its most frequent words and tables of character n-grams
(of the same words, edges marked) of ``MAX_N`` to 1 characters. A word that any
language knows is scored by each language's log frequency of it, with a penalty where
a language lacks it. A word that none knows is scored by its n-grams of the greatest
length of which any language knows one, as the mean over those; then by shorter ones.
A text's language is the one with the greatest sum over its words; its score is the
mean, over words, of that language's share of the word's likelihood.

The tables are fitted on a sample of labelled rows, ``SAMPLE_DOCS`` of a language in
expectation, taken by a hash of doc_id; a language with fewer gives all. The tables'
sizes are bounded by ``WORDS`` and ``GRAMS`` over all languages, and what occurs in the
sample fewer than ``LEAST`` times of a language is left out.

Prediction finds the words of many texts at once in arrays of code points, hashes them
and their n-grams (64 bits), and looks the hashes up in the sorted ones of the tables.

Defined cases: a null text, and one without letters, is ``und`` with score 0; so is
any text where no language was learned (an empty table, no labelled rows). A row with
a null doc_id isn't learned from and isn't held out. Equal sums give the language
first in order. Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import _words as W
from ._store import dispose, materialize, small_batches, trimmed

#: Labelled rows of a language that the tables are fitted on, in expectation.
SAMPLE_DOCS = 3000
#: Words, and n-grams of one length, of all languages together.
WORDS = 200_000
GRAMS = 100_000
MAX_N = 5
#: Subtracted, in natural-log units, from the rarest frequency for what a language lacks.
PENALTY = 2.0
#: Occurrences from which a word or n-gram of the sample is taken up.
LEAST = 2
#: Characters of text that are scored at once; a longer text is scored whole.
CHUNK_CHARS = 1 << 18
#: Characters of a word that are scored as such; a longer run of letters is scored by pieces of this length.
WORD_CHARS = 64

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, long ones in pieces."""
    found = _WORD.findall(text.lower())
    if any(len(w) > WORD_CHARS for w in found):
        found = [w[i : i + WORD_CHARS] for w in found for i in range(0, len(w), WORD_CHARS)]
    return found


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams_of(word: str, n: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language: rows of one matrix, found by word and by n-gram."""

    langs: list[str]
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    words: dict[str, int] = field(default_factory=dict)
    grams: list[dict[str, int]] = field(default_factory=list)  # by length, from 1

    def score(self, word: str) -> np.ndarray:
        """A word's log likelihood in every language."""
        known = self.words.get(word)
        if known is not None:
            return self.scores[known]
        for n in range(len(self.grams), 0, -1):
            table = self.grams[n - 1]
            edged = f" {word} "
            found = [table[g] for i in range(len(edged) - n + 1) if (g := edged[i : i + n]) in table]
            if found:
                return self.scores[found].sum(axis=0) / len(found)
        return np.zeros(len(self.langs))


def _letters() -> np.ndarray:
    """By code point: 1 where it may stand in a word, 2 where it is a letter."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() and not c.isdecimal():
            table[i] = 3 if c.isalpha() else 1
    return table


class _Hashes:
    """Hashes of the slices of an array of code points, from one prefix sum."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, self.down = W._power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(W.mix(codes + W._MULT) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return W.mix(h + (end - start).astype(np.uint64) * W._MULT)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Table:
    """Rows of a model's matrix by the hash of a word or n-gram."""

    def __init__(self, rows: dict[str, int]):
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        end = np.cumsum(size)
        h = _Hashes(_code_points("".join(rows)).astype(np.uint64)).of(end - size, end)
        order = np.argsort(h)
        self.hash, self.row = h[order], np.fromiter(rows.values(), np.int64, len(rows))[order].astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's row, -1 where it has none."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.row[at], -1)


class Predictor:
    """Predicts by a model for many texts at once, over arrays of code points."""

    def __init__(self, model: Model):
        self.langs, self.scores = model.langs, model.scores
        self.words, self.grams = _Table(model.words), [_Table(t) for t in model.grams]
        self.letters = _letters()

    def _backed_off(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log likelihoods of words that the model lacks, by their n-grams."""
        out = np.zeros((len(start), len(self.langs)))
        size = end - start + 2
        first = np.cumsum(size) - size
        who = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(who)) - first[who]  # place in the word, edges included
        edge = (at == 0) | (at == size[who] - 1)
        text = np.where(edge, np.uint64(0x20), codes[np.where(edge, 0, start[who] + at - 1)])
        hashes = _Hashes(text)
        open_ = np.ones(len(start), bool)
        for n in range(len(self.grams), 0, -1):
            begin = np.flatnonzero(open_[who] & (at + n <= size[who]))
            if not len(begin):
                continue
            row = self.grams[n - 1].find(hashes.of(begin, begin + n))
            begin, row = begin[row >= 0], row[row >= 0]
            times = np.bincount(who[begin], minlength=len(start))
            done = times > 0
            for k in range(len(self.langs)):
                total = np.bincount(who[begin], weights=self.scores[row, k], minlength=len(start))
                out[done, k] = total[done] / times[done]
            open_ &= ~done
        return out

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the language or -1, score) of every text."""
        n = len(texts)
        lang, score = np.full(n, -1), np.zeros(n)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        codes = _code_points("\n".join([*texts, ""]))
        kind = self.letters[codes]
        inside = kind > 0
        start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        if not len(start):
            return lang, score
        parts = -(-(end - start) // WORD_CHARS)
        if parts.max() > 1:
            piece = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(start, parts) + piece * WORD_CHARS
            end = np.minimum(np.repeat(end, parts), start + WORD_CHARS)
        codes = codes.astype(np.uint64)
        _, one, word = np.unique(_Hashes(codes).of(start, end), return_index=True, return_inverse=True)
        own = self.words.find(_Hashes(codes).of(start[one], end[one]))
        scores = self.scores[own]
        new = np.flatnonzero(own < 0)
        if len(new):
            scores[new] = self._backed_off(codes, start[one[new]], end[one[new]])
        shares = np.exp(scores - scores.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        text = np.searchsorted(begins, start, "right") - 1
        sums = np.stack([np.bincount(text, weights=scores[word, k], minlength=n) for k in range(len(self.langs))], axis=1)
        best = sums.argmax(axis=1)
        mean = np.bincount(text, weights=shares[word, best[text]], minlength=n) / np.maximum(1, np.bincount(text, minlength=n))
        letters = np.concatenate([[0], np.cumsum(kind >> 1)])
        some = letters[begins[1:]] > letters[begins[:-1]]
        lang[some], score[some] = best[some], np.clip(mean[some], 0, 1)
        return lang, score

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, scores)."""
        names, scores, lo, held = [], [np.zeros(0)], 0, []
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        size = 0
        for i, t in enumerate(texts):
            t = (t or "").lower()
            held.append(t)
            size += len(t) + 1
            if size >= CHUNK_CHARS or i == len(texts) - 1:
                lang, score = self._chunk(held)
                names += ["und" if k < 0 else self.langs[k] for k in lang.tolist()]
                scores.append(score)
                held, size = [], 0
        return names, np.concatenate(scores)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _count(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang].update(words_of(text))
        for lang, words in seen.items():
            tables = [words, *(Counter() for _ in range(max_n))]
            for w, c in words.items():
                for n in range(1, max_n + 1):
                    for g in grams_of(w, n):
                        tables[n][g] += c
            for n, table in enumerate(tables):
                yield pa.record_batch([pa.array([lang] * len(table)), pa.array([n] * len(table), pa.int32()), pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["lang", "n", "gram", "c"])

    return trimmed(run)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, words: int = WORDS, grams: int = GRAMS, max_n: int = MAX_N, least: int = LEAST) -> Model:
    """A model of the non-null languages of ``labelled``."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null and id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return Model([])
    langs = sorted(sizes)
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, sample_docs / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")
    counts = sample.mapInArrow(_count(max_n), "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "grams")
    totals = {(r["lang"], r["n"]): r["c"] for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    most = F.when(F.col("n") == 0, F.lit(max(1, words // len(langs)))).otherwise(F.lit(max(1, grams // len(langs))))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    kept = counts.where(F.col("c") >= least).withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "n", "gram", "c")
    place = {k: i for i, k in enumerate(langs)}
    floor = np.zeros((max_n + 1, len(langs)))
    for (lang, n), total in totals.items():
        floor[n, place[lang]] = -np.log(total) - PENALTY
    low = floor.min(axis=1)
    tables: list[dict[str, int]] = [{} for _ in range(max_n + 1)]
    found = kept.toArrow()  # at most words + max_n * grams rows
    scores = np.empty((found.num_rows, len(langs)))
    at = 0
    for batch in found.to_batches():
        for lang, n, gram, c in zip(*(column.to_pylist() for column in batch.columns)):
            i = tables[n].get(gram)
            if i is None:
                i = tables[n][gram] = at
                scores[i] = low[n]
                at += 1
            scores[i, place[lang]] = np.log(c / totals[lang, n])
    dispose(counts)
    return Model(langs, scores[:at].copy(), tables[0], tables[1:])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(Predictor(model))  # WORDS + MAX_N * GRAMS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, **fitted: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col(id_col), folds, fold)), id_col, text_col, lang_col, **fitted)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that aren't ``und`` and whose score reaches a bound; all columns stay."""
    model = fit(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(Predictor(model))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in zip(langs, scores.tolist())], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
