"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import base64
import hashlib
import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet as pq
from pyspark.sql import functions as F

from fernglass.llm import _store, bpe, cross_parsing, decontam, embedding_dedup, language_id, line_dedup, ngram_join, queries, token_count, url_filter, warc
from fernglass.llm.queries import tokenizer_file

from plain import components, contamination_of, jaccard_groups_of, language_model, language_of, line_dedup_of, shingles

CLASH = "text string, score double, n string, row int, key long, h1 string, family int, __key int"


def table(spark, rows, schema):
    """Rows with further columns whose names the operators use themselves."""
    names = {f.split()[0] for f in schema.split(", ")}
    extra = [c for c in CLASH.split(", ") if c.split()[0] not in names]
    return spark.createDataFrame([(*r, *([None] * len(extra))) for r in rows], schema + ", " + ", ".join(extra)).coalesce(2)


# -- 1 --------------------------------------------------------------------------------


def _pages(spark):
    long_ = "".join(random.Random(3).choices("abcdefghij \x1f\x8b", k=400_000))
    rows = [(1, "http://a", "x"), (2, None, "y"), (3, "http://b", "x"), (4, "c", None), (5, "d", ""), (6, "e", long_), (7, "f", long_), (2, None, "y"), (None, "g", "x"), (8, "h", "WARC/1.1\r\nWARC-Type: x\r\n\r\n")]
    return table(spark, rows, "page_id long, url string, html string"), rows


@pytest.mark.parametrize(("least", "range_bytes"), [(0, 1 << 20), (0, 777), (2, 50_000)])
def test_warc_round_trip(spark, tmp_path, least, range_bytes):
    pages, rows = _pages(spark)
    folder = f"file://{tmp_path}/w"
    assert warc.write_warc(pages, folder, least) == len(rows)
    got = sorted(map(str, (tuple(r) for r in warc.read_warc(spark, folder, range_bytes=range_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("payload").cast("string")).collect())))
    first = {}
    for i, _, html in rows:
        if i is not None and len(html or "") >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "") if i is not None else None
        to = to if to != i else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to, (html or "") if to is None else None))
    assert got == sorted(map(str, want))


def test_warc_of_nothing(spark):
    assert warc.archive_digest(_pages(spark)[0].limit(0)).collect() == []


def test_warc_passes_over_what_is_no_member(tmp_path):
    good = warc.member(warc.record_bytes(1, None, b"abc" * 1000, "X", None))
    fake = b"\x1f\x8b\x08\x00" + b"\x00" * 30 + warc.member(b"not a record") + good[:40]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(fake + good + b"junk" + good)
    size = path.stat().st_size
    for step in (13, 100, 1 << 20):
        with warc.open_file(str(path)) as f:
            assert sorted(at for lo in range(0, size, step) for at, _ in warc.read_range(f, lo, min(size, lo + step), size)) == [len(fake), len(fake) + len(good) + 4]


def test_warc_long_members_are_read_once(tmp_path):
    page = random.Random(4).randbytes(48 << 20)  # doesn't deflate
    one, two = (warc.member(warc.record_bytes(i, None, p, warc.payload_digest(p), None)) for i, p in ((1, page), (2, b"short")))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(one + two + one[: 20 << 20])
    size, began = path.stat().st_size, time.time()
    with warc.open_file(str(path)) as f:
        found = list(warc.read_range(f, 0, size, size))
        assert [at for at, _ in found] == [0, len(one)]
        assert [at for at, _ in warc.read_range(f, 5, len(one) + 1, size)] == [len(one)]
    assert warc.record_row(found[0][1])["payload"] == page and time.time() - began < 20


def test_warc_measures_payloads():
    page = b"some page" * 9
    good = warc.record_bytes(1, "u", page, warc.payload_digest(page), None)
    row = warc.record_row(good)
    assert (row["payload_bytes"], row["payload_digest"], row["payload"]) == (len(page), warc.payload_digest(page), page)
    for bad in (good.replace(page, page[:-1] + b"!"), good.replace(f"Content-Length: {len(page)}\r\n".encode(), b"Content-Length: 80\r\n")):
        assert bad != good
        with pytest.raises(warc.BadRecord):
            warc.record_row(bad)


# -- 2 --------------------------------------------------------------------------------


def test_url_rules(spark):
    rng = random.Random(1)
    labels = ["a", "b", "com", "org", "a-b", ""]
    rules = [(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(["", "/", "/x", "/x/y"]), rng.choice(["allow", "block"])) for _ in range(60)] + [(None, "/", "block"), ("com", None, "allow")]
    urls = [f"http://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}{rng.choice(['', '/', '/x', '/x/y/z?q=/x', '#f'])}" for _ in range(300)] + [None, "", "no host", "X://A.COM/x", "x://a://b/", "\nhttp://COM/\n?", "x://", "x://evil\x01.org/", "x://evil.org\x01a.b/", "x://b.evil\x02.org/x", "x://\x02.\x01/x/y", "x://many.com/p/0/1/22", "x://sub.many.com/p/0/1/2/3/4"]
    rules += [("", "", "block"), ("evil.org", "", "block"), ("org", "", "block"), ("\x01", "/x", "block"), ("evil\x02.org", "/", "allow"), ("\x01.org", "/", "allow"), ("MANY.com", "/p", "block")]
    rules += [("many.com", "/p" + "".join(f"/{x}" for x in rng.choices(range(3), k=rng.randint(1, 5))), rng.choice(["allow", "block"])) for _ in range(40)]
    pages = table(spark, [(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])], "page_id long, url string")
    best = {}
    for h, p, v in rules:
        if h is not None and p is not None and best.get((h.lower(), p)) != "block":
            best[h.lower(), p] = v

    def judge(url):
        head, sep, rest = (url or "").partition("://")
        if not sep:
            return "", "", None, "allow"
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [(len(h) + len(p), len(h), h, p) for h, p in best if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, None, "allow") if not fit else (host, path, max(fit)[2] + max(fit)[3], best[max(fit)[2:]])

    want = sorted(str((i, *judge(u))) for i, u in [*enumerate(urls), (None, urls[0]), (0, urls[0])])
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for size, salt in ((1000, 10), (7, 20)):
        assert sorted(str(tuple(r)) for r in url_filter.judge(pages, frame, range_rules=size, salt_urls=salt).collect()) == want
    assert url_filter.judge(pages.limit(0), frame).count() == 0
    many = url_filter.sort_rules([("a.com", f"/{i}", "block") for i in range(100_000)])
    began = time.time()
    assert [r[2] for r in url_filter.sweep([(url_filter.host_key("x.a.com"), f"/{i}") for i in range(10_000)], many)] == [f"/{i}" for i in range(10_000)]
    assert time.time() - began < 5  # not rule by rule
    assert {r["rule"] for r in url_filter.judge(pages, frame.limit(0), "block").collect()} == {None}


# -- 3 --------------------------------------------------------------------------------


def _longest(words, at, blocks):
    best = 0
    for b in blocks:
        for i in range(len(b)):
            k = 0
            while at + k < len(words) and i + k < len(b) and words[at + k] == b[i + k]:
                k += 1
            best = max(best, k)
    return best


def test_suffix_automaton_factors_greedily():
    rng = random.Random(5)
    for _ in range(200):
        blocks = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 4))]
        words = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        n = i = 0
        while i < len(words):
            i, n = i + max(1, _longest(words, i, blocks)), n + 1
        assert cross_parsing.SuffixAutomaton(blocks).phrases([w if w < 3 else -(1 << 60) for w in words]) == n


def _cross_parsed(rows, lengths):
    """(id, words, phrases, reference words) of (id, text, mark) rows by brute force."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    texts = [lower(t) for _, t, _ in rows]
    out = []
    for d, (i, _, _) in enumerate(rows):
        words, blocks = texts[d], [t for e, t in enumerate(texts) if e != d and rows[e][2]]
        runs = {tuple(b[j : j + k]) for k in lengths for b in blocks for j in range(len(b) - k + 1)}
        n = j = 0
        while j < len(words):
            step = 1
            for k in lengths:
                if j + k > len(words) or tuple(words[j : j + k]) not in runs:
                    break
                step = k
            j, n = j + step, n + 1
        if len(lengths) > 50:  # every length: the automaton's factoring
            number = {w: x for x, w in enumerate({w for b in blocks for w in b})}
            assert n == cross_parsing.SuffixAutomaton([[number[w] for w in b] for b in blocks]).phrases([number.get(w, -(1 << 60)) for w in words])
        out.append((i, len(words), n, sum(map(len, blocks))))
    return out


@pytest.mark.parametrize("batch", [4 << 20, 200])
@pytest.mark.parametrize("marked", [True, False])
def test_cross_parsing(spark, batch, marked):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "C", "é", "d"], k=rng.randint(0, 60))) for _ in range(40)] + [None, "", " \n"]
    texts += [texts[3], texts[5].upper() + " q q q", "x y z " * 20]
    rows = [(i, t, i % 3 != 1) for i, t in enumerate(texts)] + [(None, "a b", True), (0, texts[0], None)]
    docs = table(spark, rows, "doc_id long, text string, good boolean")
    mark = F.col("good") if marked else None
    for rounds in (((2,), (3, 4), (6, 8, 16)), tuple(tuple(range(k, k + 20)) for k in (2, 22, 42))) if marked and batch == 200 else (((2,), (4, 5)), cross_parsing.ROUNDS):
        lengths = [k for r in rounds for k in r]
        got = cross_parsing.score(docs, reference=mark, rounds=rounds, batch_bytes=batch).collect()
        want = _cross_parsed([(i, t, bool(g) or not marked) for i, t, g in rows], lengths)
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_phrases"], r["ref_words"]) for r in got) == sorted((str(i), *x) for i, *x in want)
        for r in got:
            assert r["score"] == cross_parsing.relative_entropy(r["n_words"], r["n_phrases"], r["n_own"], r["ref_words"])
            assert (r["score"] is None) == (not r["n_words"])


@pytest.mark.parametrize("split", [2, 128])
@pytest.mark.parametrize("batch", [4 << 20, 3000])
@pytest.mark.parametrize("marked", [True, False])
def test_cross_parsing_by_longest_matches(spark, batch, marked, split):
    rng = random.Random(7)
    say = lambda k: " ".join(rng.choices("abcdefgh", k=k))
    pool = [say(k) for k in (9, 13, 30, 50, 70, 100, 150, 333)]
    texts = [" ".join(rng.choice([say(rng.randint(1, 20)), *pool]) for _ in range(rng.randint(1, 4))) for _ in range(24)]
    for k in range(8):  # passages that begin and end anywhere
        words = texts[k].split() + texts[k + 8].split()
        a, b = sorted(rng.sample(range(len(words) + 1), 2))
        texts.append(" ".join(words[a:b]) + " " + say(3))
    texts += [texts[0], "the house " * 60, "house " + "the house " * 45, "x y z", None, ""]
    rows = [(i, t, i % 3 != 1) for i, t in enumerate(texts)]
    mark = F.col("good") if marked else None
    got = cross_parsing.score(table(spark, rows, "doc_id long, text string, good boolean"), reference=mark, batch_bytes=batch, split=split).collect()
    words = [(t or "").split() for t in texts]
    want = []
    for i, w in enumerate(words):
        others = [x for j, x in enumerate(words) if j != i and (rows[j][2] or not marked)]
        number = {x: n for n, x in enumerate({x for o in others for x in o})}
        n = cross_parsing.SuffixAutomaton([[number[x] for x in o] for o in others]).phrases([number.get(x, -(1 << 60)) for x in w])
        want.append((i, len(w), n, sum(map(len, others))))
    assert sorted((r["doc_id"], r["n_words"], r["n_phrases"], r["ref_words"]) for r in got) == want


def test_cross_parsing_splits_texts_once(tmp_path, monkeypatch):
    texts = ["a b A  c", None, "é b", "", "x " * 300, "a b c"]
    rows = pa.record_batch([pa.array(range(6)), pa.array(texts), pa.array([True, False, True, True, False, True])], names=["doc_id", "text", "mark"])
    found = list(cross_parsing._hash_words(1 << 20)(iter([rows.slice(0, 2), rows.slice(2)])))
    assert [b.column(c)[0].as_py() for b in found for c in ("n", "most", "rest")] == [9, 300, 2]
    pq.write_table(pa.Table.from_batches(found), f"{tmp_path}/words.parquet")

    def again(*_):
        raise AssertionError("texts are split again")

    monkeypatch.setattr(cross_parsing.W, "split_words", again)
    uri = f"file://{tmp_path}/words.parquet"
    [(ids, text, mark)] = cross_parsing._batches(uri, ids=True)
    assert ids.to_pylist() == [*range(6)] and text.size.tolist() == [4, 0, 2, 0, 300, 3] and mark.tolist() == rows.column(2).to_pylist()
    a, b, a2, c, _, b2, *_, a3, b3, c3 = text.words.tolist()
    assert (a, b, c) == (a2, b2, c3) == (a3, b3, c) and len({*text.words.tolist()}) == 5
    sent = [*cross_parsing._ask(0, ((2,),), 3, None)(iter([pa.record_batch([pa.array([0], pa.int32()), pa.array([uri])], names=["file", "uri"])]))]
    assert sum(len(x or b"") // 5 for b in sent for x, part in zip(b.column("c").to_pylist(), b.column("part").to_pylist()) if part >= 0) == 1  # "a b", of two reference texts


def test_cross_parsing_orders_and_walks():
    rng = np.random.default_rng(3)
    for top in (1, 5, 1 << 20, (1 << 64) - 1):
        key = rng.integers(0, top, 3000, dtype=np.uint64, endpoint=True)
        for k in (key, key[:0], key[:1], np.concatenate([key | np.uint64(1), key])):  # of the last some differ in the lowest bit
            assert [x.tolist() for x in cross_parsing._order(k)] == [np.argsort(k, kind="stable").tolist(), sorted(k.tolist())]
    for _ in range(200):
        bounds = np.concatenate([[0], np.cumsum(rng.integers(0, 30, 4))])
        end = np.repeat(bounds[1:], np.diff(bounds))
        lo = np.minimum(np.maximum.accumulate(np.arange(len(end)) + rng.integers(1, 9, len(end))), end)
        hi = np.minimum(np.maximum.accumulate(lo + rng.integers(0, 9, len(end)) * (rng.random(len(end)) < 0.2)), end)
        begins, want = {*bounds[:-1].tolist()}, []
        for i in range(len(end)):
            if i in begins:
                begins |= {j for j in range(lo[i], hi[i] + 1) if j < end[i]}
                want += [i] * bool(lo[i] < hi[i])
        assert cross_parsing.open_places(lo, hi, bounds).tolist() == want


def test_cross_parsing_without_reference(spark):
    docs = table(spark, [(1, "a b a b"), (2, None), (3, "a b")], "doc_id long, text string")
    found = cross_parsing.score(docs, reference=F.lit(False)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_phrases"], r["ref_words"], r["score"]) for r in found) == [(1, 4, 4, 0, None), (2, 0, 0, 0, None), (3, 2, 2, 0, None)]
    assert cross_parsing.score(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cross_parsing.score(docs, rounds=((3,), (2,)))


# -- 4 --------------------------------------------------------------------------------


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = ["".join(rng.choices(" \n\t'sdlrevemtLSV 1２½éßΣİ中🙂!._　á́<|endoftext|>", k=rng.randint(0, 40))) for _ in range(400)] + ["a<|endoftext|>'s<|startoftext|>", "<|ENDOFTEXT|>", "", None, "x" * 50_000, "it's we'll they're''s"]
    docs = table(spark, [*enumerate(texts), (None, "a"), (0, texts[0])], "doc_id long, text string")
    for size in (4, 1 << 16):
        got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(docs, path, limit=20, table_tokens=size).collect()}
        want = {(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in [*enumerate(texts), (None, "a")]}
        assert got == want
    assert token_count.count_tokens(docs.limit(0), path).count() == 0


# -- 5 --------------------------------------------------------------------------------


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choices(["Ab", "c", "d7", "é", "x9"], k=rng.choice([0, 1, 2, 5, 18, 30]))) for _ in range(25)]
    base = "one two three " + " ".join(f"w{c}" for c in "abcdefghijklmnop")
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 6))) for _ in range(40)] + [None, "", "\n", "\n\nlone line here\n", base, base.replace("wd", "other"), base.replace("wa", "x").replace("wp", "y"), "z " * 30_000, "id 1 of 2\n", "id 3 of 4", "2019", "42", "1 2 3 4 x5 6", "7 8 9 1 y2 3", "Posted by alice in general", "Posted by bob in general", "one 1 2 3 4 5", "one 1 2 x 4 5"]
    docs = table(spark, [*enumerate(texts), (None, base), (44, base)], "doc_id long, text string")
    rows = [*enumerate(texts), (None, base), (44, base)]
    want = [str((i, *x)) for (i, _), x in zip(rows, line_dedup_of(rows))]
    got = [str(tuple(r)) for r in line_dedup.find_recurring(docs).collect()]
    assert sorted(got) == sorted(want)
    kept = line_dedup.drop_recurring(docs)
    assert kept.columns == docs.columns
    assert {40, 41, 42, 43, 44, 46} <= {r["doc_id"] for r in kept.collect()}
    assert {45, 49, 55} & {r["doc_id"] for r in kept.collect()} == set() and {48, 50, 51, 52, 53, 54, 56, 57} <= {r["doc_id"] for r in kept.collect()}
    assert line_dedup.find_recurring(docs.limit(0)).count() == 0


def test_line_dedup_of_an_id_with_two_texts(spark):
    rows = [(1, "same line\nonly one"), (2, "aa\nbb\ncc\ndd\nsame line"), (2, "x y"), (2, "same line\nq r"), (2, "x y"), (3, "clean text\nof three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = [(1, rows[0][1], 2, 1, 0), (2, "aa\nbb\ncc\ndd", 5, 1, 1), (2, "x y", 1, 0, 0), (2, "q r", 2, 1, 1), (2, "x y", 1, 0, 0), (3, rows[5][1], 2, 0, 0)]
    assert sorted(tuple(r) for r in line_dedup.find_recurring(docs).collect()) == sorted(want)


# -- 6 --------------------------------------------------------------------------------


@pytest.mark.parametrize("cell_rows", [8192, 7])
def test_embeddings(spark, cell_rows):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 16))
    rows = []
    for i in range(120):
        v = base[i % 6] + rng.normal(size=16) * rng.choice([0, 0.05, 0.35])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 5 != 0)))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] + [1.0] * 15, 1), (205, rows[1][1], None), (206, [x * 1e30 for x in rows[1][1]], 1), (207, rows[1][1][:8], 1), (208, [float("inf")] * 16, 1)]
    extra = [(None, rows[1][1], 1), (1, rows[1][1], 1), (1, rows[1][1], None), (1, None, 1), (2, [0.0] * 16, 0), (3, [None] * 16, None)]
    df = table(spark, rows + extra, "vec_id long, embedding array<float>, label int")
    fine = {i: (np.float64(np.float32(v)), g) for i, v, g in rows if v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    edges = [(a, b) for a in fine for b in fine if a < b and fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0]) and fine[a][0] @ fine[b][0] / np.sqrt((fine[a][0] @ fine[a][0]) * (fine[b][0] @ fine[b][0])) >= 0.93]
    comp, n = components([r[0] for r in rows], edges), Counter(x for e in edges for x in e)
    want = sorted(str((i, n[i], comp[i], comp[i] == i)) for i, _, _ in rows) + [str((None, 0, None, False))]
    for groups in (0, 1000):
        got = embedding_dedup.near_duplicates(df, 0.93, cell_rows=cell_rows, broadcast_groups=groups)
        assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    assert len(edges) > 100
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(1)
    q = embedding_dedup.Quantised(rng.normal(size=(300, 48)) * rng.lognormal(size=(300, 1)))
    near = embedding_dedup.products(q.q, q.q).astype(float) * q.scale[:, None] * q.scale
    slack = q.error[:, None] * (q.norm + q.error) + q.norm[:, None] * q.error
    assert (abs(q.x @ q.x.T - near) <= slack).all()


# -- 7 --------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [3_000_000, 60])
def test_jaccard_groups(spark, cell, tmp_path):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 60))] for _ in range(12)]
    texts = []
    for i in range(90):
        words = [w if rng.random() > rng.choice([0, 0.05, 0.15]) else f"n{rng.randrange(50)}" for w in base[i % 12]]
        texts.append(" ".join(words))
    texts += ["", None, " \n", "One", "oNE", "a b", "A\tb", "é É", texts[0].upper(), "q " * 20_000]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3])]
    table(spark, rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    sets = {}
    for i, t in enumerate(texts):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]
    comp, n = components(list(sets), edges), Counter(x for e in edges for x in e)
    want = {(i, len(sets[i]), n[i], comp[i]) for i in sets} | {(None, len(sets[0]), 0, None)}
    for broadcast in (0, 1 << 20):
        got = ngram_join.jaccard_groups(docs, cell_shingles=cell, broadcast_ids=broadcast).collect()
        assert {tuple(r) for r in got} == want
    assert len(edges) > 100
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in sets if comp[i] == i} | {None}
    assert ngram_join.jaccard_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_jaccard_groups_of_repeated_ids_and_hot_grams(spark, broadcast):
    rng = random.Random(14)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(150):  # one group of near copies, of many sizes, that shares all frequent n-grams
        w = list(base[: rng.randint(25, 40)])
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    rows = [*enumerate(texts), *((200 + i, " ".join(rng.choices(base, k=12))) for i in range(20)), (5, "another text of five"), (5, texts[5]), (6, texts[6]), (300, "another text of five")]
    sets: dict = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(i, []).append(frozenset(zip(w, w[1:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): (r["n_similar"], r["component_id"]) for r in ngram_join.jaccard_groups(docs, broadcast_ids=broadcast, cell_shingles=300).collect()}
    assert set(got) == {(i, len(s)) for i, own in sets.items() for s in own}

    def answers(of):  # with one of its texts for the repeated id
        edges = [(a, b) for a in of for b in of if a < b and 100 * len(of[a] & of[b]) >= 60 * len(of[a] | of[b])]
        comp, n = components(list(of), edges), Counter(x for e in edges for x in e)
        return {(i, len(s)): (n[i], comp[i]) for i, own in sets.items() for s in own}

    assert got in [answers({i: own[k % len(own)] for i, own in sets.items()}) for k in (0, 1)]


@pytest.fixture
def files_apart(spark):
    """Files that are read become tasks of their own, so that batches are many."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    yield
    spark.conf.set(key, before)


def test_jaccard_families_without_sets_that_share_a_little_with_many(spark, tmp_path, monkeypatch, files_apart):
    phrase = lambda a, b: " ".join(f"{x}{min(a, b)}_{max(a, b)}" for x in "pqrstuvwx")
    texts = [" ".join(phrase(i, j) for j in range(12) if j != i) for i in range(12)]  # 88 of 98 n-grams occur elsewhere, 8 in any one
    texts += [texts[0] + " more", "a b c d e f g", "a b c d e f h"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(15, "doc_id").write.parquet(str(tmp_path / "d"))
    seen, write = set(), ngram_join.materialize

    def watch(df, tag, *rest):
        found = write(df, tag, *rest)
        if tag == "families":
            seen.update(r["rep"] for r in found.collect())
        return found

    monkeypatch.setattr(ngram_join, "materialize", watch)
    got = {tuple(r) for r in ngram_join.jaccard_groups(spark.read.parquet(str(tmp_path / "d"))).collect()}
    linked = {0: (1, 0), 12: (1, 0), 13: (1, 13), 14: (1, 13)}
    assert got == {(i, len(set(zip(t.split(), t.split()[1:]))), *linked.get(i, (0, i))) for i, t in enumerate(texts)}
    assert set(linked) <= seen and len(seen) < 12  # not all 15


def test_jaccard_groups_over_many_batches(spark, tmp_path, files_apart):
    rng = random.Random(31)
    base = [[f"w{rng.randrange(90)}" for _ in range(rng.randint(4, 50))] for _ in range(25)]
    texts = {i: " ".join(w if rng.random() > rng.choice([0, 0.05, 0.12]) else f"w{rng.randrange(90)}" for w in base[min(24, i % 40)]) for i in range(240)}  # a group of more than LISTED batches too
    spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(30).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert docs.rdd.getNumPartitions() >= 25
    got = {r["doc_id"]: (r["n_similar"], r["component_id"]) for r in ngram_join.jaccard_groups(docs, cell_shingles=200).collect()}
    assert got == jaccard_groups_of({i: shingles(t) for i, t in texts.items()})


@pytest.mark.parametrize("limit", [1 << 21, 40, 1])
def test_edges_of_sets_whose_groups_admit_each_other(limit):
    rng = np.random.default_rng(5)
    for _ in range(40):
        k = 120
        gram, n = rng.integers(0, 15, k), rng.integers(5, 30, k)
        order = np.lexsort((n, gram))
        gram, n = gram[order], n[order]
        upto, own, admits = np.minimum(n + rng.integers(-4, 8, k), 100 * n // 60), rng.integers(0, 9, k), rng.random((k, ngram_join.GROUPS)) < 0.3
        a, b = ngram_join.group_edges(gram, n, upto, np.arange(k), own, np.packbits(admits, axis=1), 60, limit)
        may = [(i, j) for i in range(k) for j in range(i) if gram[i] == gram[j] and n[i] <= upto[j] and n[j] <= upto[i] and admits[i, own[j]] and admits[j, own[i]]]
        comp = components(list(range(k)), [*zip(a.tolist(), b.tolist())])
        assert all(comp[i] == comp[j] for i, j in may)
        if limit > k * 9:  # else lists are taken whole
            assert all(gram[i] == gram[j] for i, j in zip(a, b)) and len(a) < k


# -- 8 --------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1_000_000, 30])
def test_contamination(spark, chunk):
    rng = random.Random(9)
    words = lambda k: [rng.choice("abcd") + rng.choice(["", "1", "é"]) for _ in range(k)]
    items = [(f"i{k}", " ".join(words(rng.choice([1, 3, 13, 20])))) for k in range(12)] + [("i2", "zz yy"), ("n", None), ("e", " .,"), (None, "a")]
    docs = []
    for i in range(60):
        w = words(rng.randint(0, 80))
        if i % 2:
            w[5:5] = (items[rng.randrange(12)][1] or "").split()
        docs.append((i, ("_" if i % 5 == 0 else " ").join(w).upper() if i % 7 == 0 else ". ".join(w)))
    docs += [(100, None), (101, ""), (102, "!!"), (103, "zz YY"), (None, "zz yy"), (0, docs[0][1])]
    want = [str((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n)) for (i, _), (n, hit, found) in zip(docs, contamination_of([t for _, t in docs], items))]
    frame, bench = table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id string, text string")
    got = decontam.digest(decontam.contamination(frame, bench, chunk_words=chunk))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    clean = decontam.digest(decontam.contamination(frame, bench.limit(0)))
    assert {r["n_hit"] for r in clean.collect()} == {0}
    assert decontam.drop_contaminated(frame, bench).columns == frame.columns
    assert decontam.contamination(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("chunk", [1_000_000, 3])
def test_contamination_of_repeated_and_null_ids(spark, chunk):
    items = spark.createDataFrame([("i", "aa bb"), ("j", "bb cc"), ("k", "dd")], "item_id string, text string")
    rows = [(None, "x aa bb cc"), (None, "dd"), (None, "dd"), (None, None), (7, "aa bb"), (7, "y y y bb cc y"), (7, "aa bb"), (8, "z"), (8, None), (8, "")]
    want = [(None, 4, 3, ["i", "j"]), (None, 1, 1, ["k"]), (None, 1, 1, ["k"]), (None, 0, 0, []), (7, 2, 2, ["i"]), (7, 6, 2, ["j"]), (7, 2, 2, ["i"]), (8, 1, 0, []), (8, 0, 0, []), (8, 0, 0, [])]
    found = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items, window=2, chunk_words=chunk)
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(map(str, want))


# -- 9 --------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(10)
    vocab = {"xx": ["ala", "balo", "kali", "moro"], "yy": ["stru", "grunt", "phlex", "wund"]}
    rows = [(i, " ".join(rng.choices(vocab[g], k=20)), g) for i in range(80) for g in [rng.choice(["xx", "yy"])]]
    rows += [(100, None, "xx"), (101, "", "yy"), (102, "123 !?", "xx"), (103, "Alabalo KALI", None), (104, "gruntstru", None), (105, "ala " * 30_000, "xx"), (106, "k" * 10_000, None), (None, "ala", "xx"), (0, rows[0][1], rows[0][2])]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == g for i, _, g in rows[:80])
    assert [by[i]["lang_pred"] for i in (100, 101, 102, 103, 104, 105, None)] == ["und", "und", "und", "xx", "yy", "xx", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0
    kept = language_id.keep_identified(docs, 0.3)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.count() >= 82


@pytest.mark.parametrize(("words", "grams"), [(200_000, 100_000), (30, 60)])
def test_language_id_brute_force(spark, words, grams, monkeypatch):
    rng = random.Random(11)
    parts = {"de": ["sch", "ung", "ein", "der", "ö", "ß"], "fr": ["eau", "tion", "é", "le", "qu"], "tr": ["İ", "ığı", "lar", "ş", "ne"]}
    vocab = {g: ["".join(rng.choices(p, k=rng.randint(1, 4))) for _ in range(60)] for g, p in parts.items()}
    rows = [(i, " ".join(rng.choices(vocab[g] + vocab[rng.choice(list(parts))][:20], k=rng.randint(0, 40))).title(), g) for i in range(150) for g in [rng.choice(list(parts))]]
    rows += [(1000, None, "de"), (1001, "", "fr"), (1002, "12 ² _ !?", "tr"), (1003, "zzz qqq", None), (1004, "É" * 500 + " unge", None), (1005, "a1b_c²d\u0130", None), (None, "eau le", "fr"), (7, rows[7][1], rows[7][2])]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    import zlib

    known = [(t, g) for i, t, g in rows if i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    model, floor = language_model(known, words, grams)
    want = sorted(((i, *language_of(model, floor, t)) for i, t, _ in rows), key=str)
    fitted = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))), words=words, grams=grams)
    for size in (1 << 18, 50):
        monkeypatch.setattr(language_id, "CHUNK_CHARS", size)
        langs, scores = language_id.Predictor(fitted).predict([t for _, t, _ in rows])
        got = sorted(((i, g, x) for (i, _, _), g, x in zip(rows, langs, scores.tolist())), key=str)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, words=words, grams=grams).collect()), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_language_id_words_first():
    m = language_id.Model(["a", "b"], np.log([[0.5, 0.1], [0.2, 0.4], [0.1, 0.6]]), {"ab": 0}, [{"c": 2}, {"ab": 1}])
    assert m.score("ab") == pytest.approx(np.log([0.5, 0.1]))
    assert m.score("abc") == pytest.approx(np.log([0.2, 0.4]))
    assert m.score("xcx") == pytest.approx(np.log([0.1, 0.6]))
    assert m.score("zz").tolist() == [0, 0]
    assert language_id.Predictor(m).predict(["ab", "abc", "xcx", "zz", None, "7"])[0] == ["a", "b", "b", "a", "und", "und"]
    assert language_id.Predictor(language_id.Model([])).predict(["ab", None])[0] == ["und", "und"]


# -- 10 -------------------------------------------------------------------------------


def test_byte_bpe(spark):
    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(11)
    texts = ["".join(rng.choices(" \n\t'sdlrevemt 1２½éßΣ中🙂!._　а́<|endoftext|>", k=rng.randint(0, 40))) for _ in range(400)] + ["", None, "a" * 20_000, " " * 3000, "<|endoftext|>"]
    docs = table(spark, [*enumerate(texts), (None, "a"), (0, texts[0])], "doc_id long, text string")
    want = {(i, len(ids := library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in [*enumerate(texts), (None, "a")]}
    got = bpe.digest(docs, path).collect()
    assert len(got) == len(texts) + 2 and {tuple(r) for r in got} == want
    made = bpe.encode(docs, path).where("doc_id = 0").first()
    assert made["offsets"] == np.concatenate([[0], np.cumsum([len(library.decode_single_token_bytes(i)) for i in made["ids"]])])[:-1].tolist()
    assert bpe.decode(bpe.encode(docs, path), path).where("doc_id = 0").first()["decoded"] == texts[0].encode()
    assert bpe.digest(docs.limit(0), path).count() == 0


# -- queries --------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(columns).collect())
    assert got == sorted(str(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_materialize_removes_its_shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", env.blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    before, rows = files(), spark.range(1000).repartition(3)
    found = _store.materialize(rows, "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and found.count() == rows.count() == 1000  # rows stays alive, so no garbage was collected
