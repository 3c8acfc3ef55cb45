"""URL filters: a sort-merge range join of reversed-host keys with rules.

A rule is a host and a path prefix; it fits its host and all subdomains where the
url's path starts with the prefix. A host's labels in reverse order, each closed by
a separator that labels don't hold (they are escaped), turn "this host and all below
it" into one interval of keys: the keys that begin with the rule's. A host's rules are
ordered by path, and a path's prefixes are intervals about it in the same way. Keys and
rules are sorted; one sweep over both keeps a stack of the hosts with rules whose
interval holds the current key. Intervals nest or are apart, so what ended is always on
top. Of each host on the stack the longest path that fits is found by bisection and
links to the next shorter nested path. Of the rules that fit, the longest (host and path
together, then host) wins.

Rules are swept with each batch of urls where their table is small (a checked size).
Beyond, a url's host and each host above it become probes, of that host's key and the
url's path; rules, keyed by host and path alike, are cut in key order into ranges of
``RANGE_RULES``, wherever in a host's rules that falls. Each range gets the rules that
are open at its start, and probes go to their range, spread over tasks by a salt in
proportion to the range's probes; there a sweep keeps the stack of nested rules.

Defined cases: a url that is null or has no ``://`` has an empty host and path and
no rule. Repeated rules are one; of equal rules with both verdicts, block wins. A
null verdict, host or path in a rule leaves it out. Repeated urls and page ids give
a row each. Any character may stand in hosts and paths. Other columns are ignored.
Empty tables give empty results or no rules.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, trimmed

#: Rules that one task sweeps; beyond, rules are cut into ranges.
RANGE_RULES = 200_000
#: Probes of one salt of a range.
SALT_URLS = 2_000_000

SEP = "\x01"
#: How what has a meaning in keys is written where it stands in a label.
ESCAPES = {"\x02": "\x02\x04", SEP: "\x02\x03"}
#: Closes a host's key before a path.
END = "\x02\x05"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    """The host's labels in reverse order, each closed by the separator."""
    for c, to in ESCAPES.items():
        host = host.replace(c, to)
    return "".join(label + SEP for label in reversed(host.split(".")))


def _labels(host: Column) -> Column:
    for c, to in ESCAPES.items():
        host = F.replace(host, F.lit(c), F.lit(to))
    return F.reverse(F.split(host, r"\."))


def key_column(host: Column) -> Column:
    return F.concat(F.array_join(_labels(host), SEP), F.lit(SEP))


Rule = tuple[str, str, str, str]  # key, host, path, verdict


class HostRules:
    """The rules of one host by path, each with the next shorter one that it begins with."""

    def __init__(self, rules: list[Rule]):
        self.key, self.host = rules[0][:2]
        self.rules, self.paths = rules, [r[2] for r in rules]
        self.shorter: list[int] = []
        stack: list[int] = []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.shorter.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> Rule | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.shorter[i]
        return self.rules[i] if i >= 0 else None


def sort_rules(rules: list[tuple[str, str, str]]) -> list[HostRules]:
    """(host, path, verdict) rows as sorted hosts with rules, repeated ones once."""
    best: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        host = host.translate(str.maketrans(*_LOWER))
        if best.get((host, path)) != "block":
            best[host, path] = verdict
    by_host: dict[str, list[Rule]] = {}
    for key, host, path, verdict in sorted((host_key(h), h, p, v) for (h, p), v in best.items()):
        by_host.setdefault(key, []).append((key, host, path, verdict))
    return [HostRules(own) for own in by_host.values()]


def sweep(keys: list[tuple[str, str]], hosts: list[HostRules]) -> list[Rule | None]:
    """The rule of every (key, path); keys in any order, hosts sorted."""
    out: list[Rule | None] = [None] * len(keys)
    stack: list[HostRules] = []
    k, last = 0, None
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key, path = keys[i]
        if key != last:
            while k < len(hosts) and hosts[k].key <= key:
                while stack and not hosts[k].key.startswith(stack[-1].key):
                    stack.pop()
                stack.append(hosts[k])
                k += 1
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            last = key
        best = None
        for host in stack:
            rule = host.longest(path)
            if rule and (best is None or (len(rule[1]) + len(rule[2]), len(rule[1])) > (len(best[1]) + len(best[2]), len(best[1]))):
                best = rule
        out[i] = best
    return out


def _judged(batch: pa.RecordBatch, found: list[Rule | None], width: int) -> pa.RecordBatch:
    rule = pa.array([None if r is None else r[1] + r[2] for r in found], pa.string())
    verdict = pa.array([None if r is None else r[3] for r in found], pa.string())
    names = batch.schema.names[:width]
    return pa.record_batch([*(batch.column(i) for i in range(width)), rule, verdict], names=[*names, "rule", "verdict"])


def _map_side(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()))
            some = [i for i, (k, _) in enumerate(keys) if k is not None]
            found: list[Rule | None] = [None] * len(keys)
            for i, rule in zip(some, sweep([keys[i] for i in some], rules.value)):
                found[i] = rule
            yield _judged(batch, found, 3)

    return trimmed(run)


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, path, verdict) of the probes that a rule fits; rows sorted by range, salt, key and kind, rules before probes."""
    at, stack = None, []
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            spot = r["range"], r["salt"]
            if spot != at:
                at, stack = spot, []
            key = r["key"]
            while stack and not key.startswith(stack[-1]["key"]):
                stack.pop()
            if r["kind"] < 2:
                stack.append(r)
            elif stack:
                found.append((r["row"], stack[-1]["host"], stack[-1]["path"], stack[-1]["verdict"]))
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["row", "host", "path", "verdict"])


def cut_rules(rules: DataFrame, range_rules: int) -> tuple[list[str], DataFrame]:
    """(first key of each range, rules with range and kind: 0 where open at the range's start, 1 where its own)."""
    spark = rules.sparkSession
    parts = max(1, -(-rules.count() // range_rules))
    ordered = materialize(rules.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "rules")
    firsts = ordered.groupBy("part").agg(F.min("key").alias("k")).orderBy("k").collect()  # one a range
    starts = [r["k"] for r in firsts]
    numbers = spark.createDataFrame([(r["part"], i) for i, r in enumerate(firsts)], "part int, range int")
    own = ordered.join(F.broadcast(numbers), "part").select("key", "host", "path", "verdict", "range", F.lit(1).alias("kind"))
    # rules open at a range's start have a proper prefix of its first key
    prefixes = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "range int, start string").select("range", F.explode(F.transform(F.sequence(F.lit(1), F.length("start")), lambda n: F.substring("start", F.lit(1), n - 1))).alias("key"))
    opened = ordered.join(prefixes, "key").select("key", "host", "path", "verdict", "range", F.lit(0).alias("kind"))
    return starts, opened.unionByName(own)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", range_rules: int = RANGE_RULES, salt_urls: int = SALT_URLS) -> DataFrame:
    """page_id, host, path, rule (host and path, null where none fits), verdict of every row."""
    url = F.col(url_col).cast("string")
    rows = urls.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.contains(url, F.lit("://")), key_column(host_of(url))).alias("key"))
    clean = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
    kind = rows.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, host string, path string, rule string, verdict string"
    few = clean.limit(range_rules + 1).collect()  # one more than a task sweeps tells whether they are more
    if len(few) <= range_rules:
        found = rows.mapInArrow(_map_side(rows.sparkSession.sparkContext.broadcast(sort_rules([tuple(r) for r in few]))), out)
    else:
        found = _range_join(rows, clean, out, kind, range_rules, salt_urls)
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def _range_join(rows: DataFrame, rules: DataFrame, out: str, kind: str, range_rules: int, salt_urls: int) -> DataFrame:
    spark = rows.sparkSession
    host = F.translate("host", *_LOWER)
    once = rules.select(host.alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" > "allow"
    starts, cut = cut_rules(once.withColumn("key", F.concat(key_column(F.col("host")), F.lit(END), "path")), range_rules)
    where = spark.sparkContext.broadcast(starts)  # one a range

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [max(0, bisect_right(where.value, k) - 1) for k in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(at, pa.int32())], names=["row", "key", "range"])

    urls = materialize(rows.select("page_id", "host", "path", F.col("key").isNotNull().alias("asked"), F.monotonically_increasing_id().alias("row")), "urls")
    depth = F.explode(F.sequence(F.lit(1), F.size("labels")))
    each = urls.where("asked").withColumn("labels", _labels(F.col("host"))).select("row", "path", "labels", depth.alias("depth"))
    probes = each.select("row", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("depth")), SEP), F.lit(SEP + END), "path").alias("key"))
    placed = materialize(probes.mapInArrow(number, "row long, key string, range int"), "probes")
    salts = placed.groupBy("range").agg(F.ceil(F.count("*") / salt_urls).cast("int").alias("salts"))
    salts = F.broadcast(materialize(salts, "salts"))  # one row a range
    none = F.lit(None).cast("string")
    asked = placed.join(salts, "range").select("range", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), "key", F.lit(2).alias("kind"), none.alias("host"), none.alias("path"), none.alias("verdict"), "row")
    spread = cut.join(salts, "range").select("range", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "kind", "host", "path", "verdict", F.lit(None).cast("long").alias("row"))
    both = spread.unionByName(asked).repartition("range", "salt").sortWithinPartitions("range", "salt", "key", "kind")
    fits = both.mapInArrow(_ranged, "row long, host string, path string, verdict string")
    length = F.struct(F.length("host") + F.length("path"), F.length("host"))
    best = fits.groupBy("row").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), length).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", "best.rule", "best.verdict")
