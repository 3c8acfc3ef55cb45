"""The pipeline against plain Python, on a table with nulls, ties, repeated rows, long texts and further columns."""

import hashlib
import os
import random
import zlib

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from fernglass.llm import bpe
from fernglass.llm.queries import QUERIES, tokenizer_file
from plain import contamination_of, jaccard_groups_of, language_model, language_of, line_dedup_of, shingles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, gram string"


def _documents():
    rng = random.Random(15)
    vocab = {"de": "der die und schule ein nicht über straße mit haus von zeit", "fr": "le la les une école avec été temps maison pour dans", "en": "the of and school with house time not for in street"}
    say = lambda g, k: " ".join(rng.choices(vocab[g].split(), k=k))
    items = [(f"i{k}", say(rng.choice(list(vocab)), rng.choice([14, 20]))) for k in range(5)] + [("n", None), (None, "the"), ("one", "zzz")]
    docs = []
    for i in range(120):
        g = rng.choice(list(vocab))
        docs.append((i, "\n".join(say(g, rng.randint(1, 40)) for _ in range(rng.randint(1, 4))), rng.choice([g, g, None])))
    docs += [(200 + k, "menu home about contact\n" + docs[k][1] + " ende", docs[k][2]) for k in range(15)]
    docs += [(300 + k, say("en", 10) + "\n" + str(items[k][1]) + "\n" + say("en", 9), "en") for k in range(5)]
    docs += [(400, None, "de"), (401, "", "fr"), (402, "12 34 !?", None), (403, "zzz the house", "en"), (404, "the house " * 4000, None), (405, docs[3][1], docs[3][2]), docs[3], docs[3], (None, docs[4][1], "fr"), (None, None, None), (406, "\n \n", "en"), (407, "menu home about contact", "en"), (408, "menu home above contact", "en")]
    rng.shuffle(docs)
    return docs, items


def _plain(docs, items):
    """The rows that are left after each stage."""
    known = [(t, g) for i, t, g in docs if i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    model, floor = language_model(known, 200_000, 100_000)
    found = [language_of(model, floor, t) for _, t, _ in docs]
    stages = [[d for d, (g, score) in zip(docs, found) if g != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE]]
    cleaned = line_dedup_of([(i, t) for i, t, _ in stages[-1]])
    stages.append([(i, new, g) for (i, _, g), (new, _, _, dropped) in zip(stages[-1], cleaned) if new.strip() or not dropped])
    groups = jaccard_groups_of({i: shingles(t) for i, t, _ in stages[-1] if i is not None})
    stages.append([d for d in stages[-1] if d[0] is None or groups[d[0]][1] == d[0]])
    found = contamination_of([t for _, t, _ in stages[-1]], items)
    bad = {i for (i, _, _), (n, hit, _) in zip(stages[-1], found) if hit and 20 * hit >= n}
    stages.append([d for d in stages[-1] if d[0] is None or d[0] not in bad])
    return stages


def _encoded(docs):
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    out = []
    for i, t, _ in docs:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def _written(spark, folder, docs, items):
    rows = [(i, t, g, None if i is None or i % 3 else "s", None if t is None else len(t), None, 1, "x") for i, t, g in docs]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_and_run_match_plain_python(spark, tmp_path):
    docs, items = _documents()
    _written(spark, tmp_path, docs, items)
    want = _plain(docs, items)
    assert len({len(docs), *map(len, want)}) == 5  # every stage lets something go
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == columns, name
        assert sorted(str(tuple(r)) for r in now.select("doc_id", "text", "lang").collect()) == sorted(map(str, want[k])), name
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, _encoded(want[-1])))


def test_empty_tables(spark, tmp_path):
    _written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    _written(spark, f"{tmp_path}/b", [(1, None, None), (None, "the house", "en")], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0  # nothing to learn a language from


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert docs.count() * 0.8 < got.join(docs.select("doc_id"), "doc_id").where(F.col("n_tokens") > 0).count() <= docs.count()


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
