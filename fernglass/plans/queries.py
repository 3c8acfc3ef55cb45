"""The engine's registered queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.operators.collection import Collection, FindOptions
from fernglass.operators.filter import find
from fernglass.sources.documents import has_field, parse_documents, rejected, shred

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _filter(name: str, source: str, query: dict, where: str) -> None:
    """A filter over a typed table."""
    QUERIES[name] = lambda spark, sf_dir: find(table(spark, sf_dir, source), query)
    ORACLE_SQL[name] = f"SELECT * FROM {source} WHERE {where}"


_filter("lt", "events", {"user_id": {"$lt": 20}}, "user_id < 20")
_filter("lt_float", "events", {"user_id": {"$lt": 7.3}}, "user_id < 7.3")
_filter("lte", "events", {"value": {"$lte": 12.5}}, "value <= 12.5")
_filter("gt", "orders", {"o_totalprice": {"$gt": 250000}}, "o_totalprice > 250000")
_filter("gte", "lineitem", {"l_quantity": {"$gte": 49}}, "l_quantity >= 49")
_filter("gte_string", "customer", {"c_mktsegment": {"$gte": "HOUSEHOLD"}}, "c_mktsegment >= 'HOUSEHOLD'")
_filter("ne", "events", {"event_type": {"$ne": "view"}}, "event_type IS DISTINCT FROM 'view'")
_filter("in", "events", {"user_id": {"$in": [3, 5, 8, 13]}}, "user_id IN (3, 5, 8, 13)")
_filter("nin", "events", {"event_type": {"$nin": ["view", "click"]}}, "event_type IS NULL OR event_type NOT IN ('view', 'click')")
_filter("eq_int", "orders", {"o_custkey": 42}, "o_custkey = 42")
_filter("eq_float", "part", {"p_size": 7.0}, "p_size = 7")
_filter("eq_string", "events", {"event_type": "purchase"}, "event_type = 'purchase'")
_filter("eq_null", "events", {"event_type": None}, "event_type IS NULL")
_filter("multi_op", "events", {"user_id": {"$gte": 3, "$lt": 5}}, "user_id >= 3 AND user_id < 5")
_filter("multi_field", "lineitem", {"l_returnflag": "R", "l_quantity": {"$lt": 5}, "l_discount": {"$gte": 0.05}}, "l_returnflag = 'R' AND l_quantity < 5 AND l_discount >= 0.05")
_filter("match_all", "nation", {}, "true")
_filter("time_range", "orders", {"o_orderdate": {"$gte": "1995-01-01T00:00:00", "$lt": "1995-03-01T00:00:00"}}, "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01'")


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with their JSON text as VARIANT."""
    return table(spark, sf_dir, "events").withColumn("props", F.try_parse_json("props"))


def _variant(name: str, query: dict, where: str) -> None:
    """A filter into documents held as VARIANT, by dotted paths."""
    QUERIES[name] = lambda spark, sf_dir: find(_props(spark, sf_dir), query).select("event_id", F.try_variant_get("props", "$.k", "bigint").alias("k"))
    ORACLE_SQL[name] = f"SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE {where}"


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_variant("variant_gte", {"props.k": {"$gte": 50}}, f"{_K} >= 50")
_variant("variant_range", {"props.k": {"$gt": 10.5, "$lte": 20}}, f"{_K} > 10.5 AND {_K} <= 20")
_variant("variant_eq", {"props.k": 17}, f"{_K} = 17")
_variant("variant_ne", {"props.k": {"$ne": 17}}, f"{_K} IS DISTINCT FROM 17")
_variant("variant_in", {"props.k": {"$in": [1, 2, 3]}}, f"{_K} IN (1, 2, 3)")
_variant("variant_nin", {"props.k": {"$nin": [1, 2, 3]}}, f"{_K} NOT IN (1, 2, 3)")
_variant("variant_object", {"props": {"k": 17}}, f"{_K} = 17")
_variant("variant_type", {"props.k": "17"}, "false")


@register("struct_path", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity < 3 AND l_tax <= 0.02")
def _struct_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names into structs."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_quantity", "l_tax").alias("item"))
    return find(rows, {"item.l_quantity": {"$lt": 3}, "item.l_tax": {"$lte": 0.02}}).select("l_orderkey", "l_linenumber", "item.*")


@register("field_presence", "SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.absent') AS has_absent FROM events")
def _field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda n: F.try_variant_get("props", f"$.{n}", "variant").isNotNull()
    return _props(spark, sf_dir).select("event_id", has("k").alias("has_k"), has("absent").alias("has_absent"))


# -- collections -----------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> Collection:
    """events as documents: each row's object in one VARIANT."""
    rows = table(spark, sf_dir, "events").where("props is not null")
    doc = F.to_variant_object(F.struct("event_id", "user_id", F.col("event_type").alias("kind"), F.try_parse_json("props").alias("props")))
    return Collection(rows.select(doc.alias("doc")), "doc")


@register("find_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def _find_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, skip, limit and columns."""
    options = FindOptions(select=("o_orderkey", "o_totalprice"), order_by=(("o_totalprice", False), ("o_orderkey", True)), skip=10, limit=25)
    return Collection(table(spark, sf_dir, "orders")).find({"o_orderstatus": "F"}, options)


@register("find_page_variant", f"SELECT event_id, {_K} AS k FROM events WHERE user_id < 50 ORDER BY k DESC, event_id LIMIT 25")
def _find_page_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by paths into documents."""
    options = FindOptions(select=("event_id", "props.k"), order_by=(("props.k", False), ("event_id", True)), limit=25)
    found = _events(spark, sf_dir).find({"user_id": {"$lt": 50}}, options)
    return found.select(F.col("event_id").cast("bigint"), F.col("`props.k`").cast("bigint").alias("k"))


@register("insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region")
def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a column."""
    more = table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return Collection(table(spark, sf_dir, "nation")).insert(more).rows


@register("update", "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 20 THEN p_size * 2 ELSE p_size END AS p_size, CASE WHEN p_size BETWEEN 10 AND 20 THEN 'x' ELSE p_brand END AS p_brand FROM part")
def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = Collection(table(spark, sf_dir, "part")).update({"p_size": {"$gte": 10, "$lte": 20}}, {"p_size": F.col("p_size") * 2, "p_brand": "x"})
    return done.collection.rows.select("p_partkey", "p_size", "p_brand")


@register("update_variant", f"SELECT event_id, {_K} + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS k, CASE WHEN event_type = 'click' THEN event_id END AS seen FROM events")
def _update_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of documents, one of them new."""
    at = lambda path: F.try_variant_get("doc", path, "bigint")
    done = _events(spark, sf_dir).update({"kind": "click"}, {"props.k": at("$.props.k") + 1, "seen.by": at("$.event_id")})
    return done.collection.rows.select(at("$.event_id").alias("event_id"), at("$.props.k").alias("k"), at("$.seen.by").alias("seen"))


@register("delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 150000)")
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collection(table(spark, sf_dir, "orders")).delete({"o_orderstatus": "F", "o_totalprice": {"$lt": 150000}}).rows.select("o_orderkey", "o_orderstatus")


# -- null and missing values -----------------------------------------------------------


def _with_null(name: str, query: dict, where: str) -> None:
    """A filter over a column that has nulls."""
    rows = "SELECT event_id, nullif(event_type, 'view') AS kind FROM events"
    QUERIES[name] = lambda spark, sf_dir: find(table(spark, sf_dir, "events").select("event_id", F.expr("nullif(event_type, 'view')").alias("kind")), query)
    ORACLE_SQL[name] = f"SELECT * FROM ({rows}) WHERE {where}"


_with_null("null_eq", {"kind": None}, "kind IS NULL")
_with_null("null_ne", {"kind": {"$ne": "click"}}, "kind IS DISTINCT FROM 'click'")
_with_null("null_ne_null", {"kind": {"$ne": None}}, "kind IS NOT NULL")
_with_null("null_in", {"kind": {"$in": [None, "click"]}}, "kind IS NULL OR kind = 'click'")
_with_null("null_nin", {"kind": {"$nin": ["click", "error"]}}, "kind IS NULL OR kind NOT IN ('click', 'error')")
_with_null("null_nin_null", {"kind": {"$nin": ["click", None]}}, "kind <> 'click'")


# -- JSON documents --------------------------------------------------------------------

_LINES = """SELECT CASE event_type WHEN 'error' THEN 'no json' WHEN 'view' THEN '[1]' WHEN 'signup' THEN '{"a":1,"a":2}'
  ELSE '{"_id":' || event_id || ',"a\\"b":' || user_id || ',"n":[' || user_id || ',1e0,{"z":null,"y":"' || event_type || '"}]}' END AS value, event_id, user_id, event_type FROM events"""
_GOOD = f"({_LINES}) WHERE event_type NOT IN ('error', 'view', 'signup')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line, or what isn't one, of every event."""
    good = F.concat(F.lit('{"_id":'), "event_id", F.lit(',"a\\"b":'), "user_id", F.lit(',"n":['), "user_id", F.lit(',1e0,{"z":null,"y":"'), "event_type", F.lit('"}]}'))
    kind = F.col("event_type")
    bad = F.when(kind == "error", "no json").when(kind == "view", "[1]").when(kind == "signup", '{"a":1,"a":2}')
    return table(spark, sf_dir, "events").select(bad.otherwise(good).alias("value"))


@register("parse_documents", f"SELECT CAST(event_id AS VARCHAR) AS _id, user_id AS first FROM {_GOOD}")
def _parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_documents(_lines(spark, sf_dir)).select("_id", F.try_variant_get("doc", "$.n[0]", "bigint").alias("first"))


@register("rejected", f"SELECT value FROM ({_LINES}) WHERE event_type IN ('error', 'view', 'signup')")
def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(_lines(spark, sf_dir))


@register("has_field", f"SELECT CAST(event_id AS VARCHAR) AS _id, true AS quoted, false AS other FROM {_GOOD}")
def _has_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names of any characters."""
    return parse_documents(_lines(spark, sf_dir)).select("_id", has_field('a"b').alias("quoted"), has_field("a]b").alias("other"))


@register("shred", f"SELECT CAST(event_id AS VARCHAR) AS _id, user_id FROM {_GOOD} AND user_id >= 40")
def _shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns of fields, and a filter on one."""
    typed = shred(parse_documents(_lines(spark, sf_dir)), {'a"b': "bigint"}).withColumnRenamed('a"b', "user_id")
    return find(typed, {"user_id": {"$gte": 40}}).select("_id", "user_id")


@register("nested_eq", f"SELECT CAST(event_id AS VARCHAR) AS _id FROM {_GOOD} AND user_id = 7 AND event_type = 'click'")
def _nested_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and objects are equal by value: 1 is 1e0, and keys have no order."""
    return find(parse_documents(_lines(spark, sf_dir)), {"n": [7.0, 1, {"y": "click", "z": None}]}, variant="doc").select("_id")
