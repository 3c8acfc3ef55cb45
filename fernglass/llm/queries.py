"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cross_parsing, decontam, embedding_dedup, language_id, line_dedup, ngram_join, token_count, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file, by default that of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"), min_bytes=0)


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, default="allow")


def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the text of all others."""
    return cross_parsing.score(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), limit=2048)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.find_recurring(table(spark, sf_dir, "documents")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), n=2, threshold=60)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return decontam.digest(found, share=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


QUERIES |= {f.__name__: f for f in (op1_warc, op2_url_filter, op3_cross_parsing, op4_token_counts, op5_line_dedup, op6_embedding_near_dedup, op7_ngram_jaccard_join, op8_benchmark_decontamination, op9_language_id, op10_byte_bpe)}

ORACLE_SQL["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM d"""

ORACLE_SQL["op2_url_filter"] = """
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)"""

_WORDS8 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS7 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT v AS vec_id, (SELECT count(*) FROM l WHERE l.x = m.v) AS n_links, c AS component_id, v = c AS kept FROM m"""

ORACLE_SQL["op7_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, g, hash(g) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM k a JOIN k b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 60 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT n.doc_id, n.n AS n_shingles, count(l.y) AS n_similar, m.c AS component_id
FROM n JOIN m ON m.v = n.doc_id LEFT JOIN l ON l.x = n.doc_id GROUP BY n.doc_id, n.n, m.c"""

ORACLE_SQL["op8_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS8} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, j, j + least(13, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM k),
p AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS j FROM d, z WHERE len(w) >= size),
h AS (SELECT p.doc_id, p.j, p.size, k.item_id FROM p JOIN k ON k.size = p.size AND k.s = array_to_string(list_slice(p.w, p.j, p.j + p.size - 1), ' ')),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + size)) AS q FROM (SELECT DISTINCT doc_id, j, size FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_TOKENS5 = r"regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_LO5, _HI5 = "(2 + (len(w) - 2) * q // 4)", "(2 + (len(w) - 2) * (q + 1) // 4)"

ORACLE_SQL["op5_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS pieces FROM documents),
l AS (SELECT r, doc_id, unnest(pieces) AS line, unnest(range(1, len(pieces) + 1)) AS k FROM d WHERE text <> ''),
t AS (SELECT r, doc_id, k, w, list_transform(w, lambda x: regexp_matches(x, '[0-9]')) AS digits FROM (SELECT r, doc_id, k, {_TOKENS5} AS w FROM l) WHERE len(w) > 0),
f AS (SELECT r, doc_id, k, w, CASE WHEN list_bool_and(digits) THEN list_transform(w, lambda x: false) ELSE digits END AS free FROM t),
g AS (SELECT r, doc_id, k, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN free[i] THEN '0' ELSE w[i] END) AS w, free FROM f),
p AS (SELECT r, doc_id, k, 'all ' || array_to_string(w, ' ') AS name FROM g
  UNION ALL SELECT r, doc_id, k, q || ' ' || len(w) || ' ' || array_to_string(w[:{_LO5}], ' ') || '  ' || array_to_string(w[{_HI5} + 1:], ' ')
  FROM g, (SELECT unnest(range(0, 4)) AS q) WHERE len(w) >= 5 AND {_HI5} > {_LO5}
    AND 2 * (len(list_filter(free[:{_LO5}], lambda x: NOT x)) + len(list_filter(free[{_HI5} + 1:], lambda x: NOT x))) >= len(w)),
n AS (SELECT name, min(doc_id) AS least FROM p WHERE doc_id IS NOT NULL GROUP BY name HAVING min(doc_id) <> max(doc_id)),
j AS (SELECT r, k, bool_or(n.least IS NOT NULL) AS recurs, bool_or(coalesce(n.least <> doc_id, false)) AS goes FROM p LEFT JOIN n USING (name) WHERE doc_id IS NOT NULL GROUP BY r, k),
a AS (SELECT l.r, count(*) AS n_lines, count(*) FILTER (WHERE recurs) AS n_recurring, count(*) FILTER (WHERE goes) AS n_dropped, coalesce(bool_or(goes) FILTER (WHERE k = len(pieces)), false) AS ending,
    coalesce(string_agg(line || CASE WHEN k < len(pieces) OR ends_with(text, chr(10)) THEN chr(10) ELSE '' END, '' ORDER BY k) FILTER (WHERE NOT coalesce(goes, false)), '') AS kept
  FROM l JOIN d USING (r) LEFT JOIN j USING (r, k) GROUP BY l.r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_recurring, 0) AS n_recurring, coalesce(n_dropped, 0) AS n_dropped,
  sha256(CASE WHEN coalesce(n_dropped, 0) = 0 THEN coalesce(text, '') WHEN ending AND ends_with(kept, chr(10)) THEN left(kept, length(kept) - 1) ELSE kept END) AS text_sha256
FROM d LEFT JOIN a USING (r)"""

# the fit takes all rows that aren't held out, as the query does while no language has more of them than SAMPLE_DOCS
ORACLE_SQL["op9_language_id"] = r"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, text, lang, coalesce(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 4 = 2, false) AS held_out FROM documents),
o AS (SELECT r, x AS word, count(*) AS c FROM (SELECT r, unnest(flatten(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+'), lambda x: list_transform(range(0, length(x), 64), lambda i: substr(x, i + 1, 64))))) AS x FROM h) GROUP BY r, x),
k AS (SELECT lang, word, sum(c) AS c FROM o JOIN h USING (r) WHERE NOT held_out AND lang IS NOT NULL AND doc_id IS NOT NULL GROUP BY lang, word),
langs AS (SELECT lang, count(*) OVER () AS many FROM (SELECT DISTINCT lang FROM h WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL)),
z AS (SELECT unnest(range(1, 6)) AS n),
g AS (SELECT lang, 0 AS n, word AS gram, c FROM k
  UNION ALL SELECT lang, n, gram, sum(c) FROM (SELECT lang, n, unnest(list_transform(range(1, length(word) + 4 - n), lambda i: substr(' ' || word || ' ', i, n))) AS gram, c FROM k, z) GROUP BY lang, n, gram),
totals AS (SELECT lang, n, sum(c) AS total FROM g GROUP BY lang, n),
low AS (SELECT n, min(-ln(total)) - 2.0 AS low FROM totals GROUP BY n),
m AS (SELECT lang, n, gram, ln(c / total) AS s FROM (SELECT *, row_number() OVER (PARTITION BY lang, n ORDER BY c DESC, gram) AS place FROM g WHERE c >= 2) JOIN totals USING (lang, n) JOIN langs USING (lang)
  WHERE place <= CASE WHEN n = 0 THEN 200000 // many ELSE 100000 // many END),
any_ AS (SELECT DISTINCT n, gram FROM m),
v AS (SELECT DISTINCT word FROM o),
own AS (SELECT word, 0 AS n, word AS gram FROM v JOIN any_ ON any_.n = 0 AND any_.gram = word),
parts AS (SELECT word, p.n, p.gram FROM (SELECT word, n, unnest(list_transform(range(1, length(word) + 4 - n), lambda i: substr(' ' || word || ' ', i, n))) AS gram FROM (SELECT word FROM v ANTI JOIN own USING (word)), z) AS p JOIN any_ USING (n, gram)),
best AS (SELECT word, n, gram FROM own UNION ALL SELECT word, n, gram FROM parts JOIN (SELECT word, max(n) AS n FROM parts GROUP BY word) USING (word, n)),
s AS (SELECT v.word, langs.lang, coalesce(avg(coalesce(m.s, low.low)) FILTER (WHERE best.n IS NOT NULL), 0) AS s
  FROM v CROSS JOIN langs LEFT JOIN best USING (word) LEFT JOIN low ON low.n = best.n LEFT JOIN m ON m.lang = langs.lang AND m.n = best.n AND m.gram = best.gram GROUP BY v.word, langs.lang),
e AS (SELECT word, lang, s, exp(s - max(s) OVER (PARTITION BY word)) AS e FROM s),
w AS (SELECT word, lang, s, e / sum(e) OVER (PARTITION BY word) AS share FROM e),
d AS (SELECT r, lang, sum(c * s) AS total, sum(c * share) / sum(c) AS share FROM o JOIN w USING (word) GROUP BY r, lang),
a AS (SELECT r, lang, share FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY round(total, 9) DESC, lang) AS place FROM d) WHERE place = 1)
SELECT doc_id, held_out, CASE WHEN regexp_matches(text, '\p{L}') THEN coalesce(a.lang, 'und') ELSE 'und' END AS lang_pred,
  CASE WHEN regexp_matches(text, '\p{L}') THEN coalesce(round(share, 6), 0) ELSE 0 END AS score
FROM h LEFT JOIN a USING (r)"""
