import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fernglass.errors import FilterError, OptionError
from fernglass.operators.collection import Collection, FindOptions
from fernglass.operators.filter import check_filter, find, parse_filter
from fernglass.sources.documents import has_field, parse_documents, rejected, shred

LINES = [
    '{"_id":1,"a":3}', '{"_id":2,"a":-3}', '{"_id":3,"a":9007199254740993}', '{"_id":4,"a":18446744073709551616}', '{"_id":5,"a":7.3}', '{"_id":6,"a":1e0}',
    '{"_id":7,"a":"x"}', '{"_id":8,"a":"7"}', '{"_id":9,"a":true}', '{"_id":10,"a":null}', '{"_id":11}', '{"_id":12,"a":{}}', '{"_id":13,"a":[]}',
    '{"_id":14,"a":[3,"x"]}', '{"_id":15,"a":{"b":3,"c":[1]}}', '{"_id":16,"a.b":3}',
]


@pytest.fixture(scope="module")
def docs(spark):
    return parse_documents(spark.createDataFrame([(x,) for x in LINES], "value string")).cache()


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ({"a": 3}, [1]), ({"a": 3.0}, [1]), ({"a": 1}, [6]), ({"a": "7"}, [8]), ({"a": True}, [9]), ({"a": None}, [10, 11, 16]), ({"a": {}}, [12]), ({"a": []}, [13]),
        ({"a": [3, "x"]}, [14]), ({"a": [3e0, "x"]}, [14]), ({"a": ["x", 3]}, []), ({"a": [3]}, []), ({"a": {"b": 3.0, "c": [1.0]}}, [15]), ({"a": {"b": 3}}, []), ({"a": {"b": 3, "c": [None]}}, []), ({"a": {"c": [1], "b": 3}}, [15]), ({"a.b": 3}, [15]), ({"a": {"$lt": 3}}, [2, 6]), ({"a": {"$lte": 3}}, [1, 2, 6]), ({"a": {"$gt": 7}}, [3, 4, 5]),
        ({"a": {"$gte": 9007199254740993}}, [3, 4]), ({"a": {"$gt": 9007199254740993}}, [4]), ({"a": {"$gte": 7.3}}, [3, 4, 5]), ({"a": {"$gte": "7"}}, [7, 8]), ({"a": {"$lt": {}}}, []),
        ({"a": {"$ne": 3}}, [2, *range(3, 17)]), ({"a": {"$in": [3, "x", None]}}, [1, 7, 10, 11, 16]), ({"a": {"$nin": [3, None]}}, [2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14, 15]), ({"a": {"$in": []}}, []),
        ({"a": {"$gt": 0, "$lt": 5}}, [1, 6]), ({}, list(range(1, 17))), ({"missing": {"$ne": 1}}, list(range(1, 17))), ({"_id": {"$lte": "1"}, "a": 3}, [1]),
    ],
)
def test_variant(docs, query, ids):
    found = find(docs, query, variant="doc")
    assert sorted(int(r["_id"]) for r in found.collect()) == ids


def test_literal_keys(docs):
    assert [r["_id"] for r in find(docs, {"a.b": 3}, variant="doc", literal_keys=True).collect()] == ["16"]


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True), (2, None, None, None), (None, -1.0, "b", False)], "i int, d double, s string, b boolean")
    count = lambda q: find(df, q).count()
    assert [count({"i": {"$lt": x}}) for x in (1, 1.5, 1 << 40, -(1 << 40))] == [0, 1, 2, 0]
    assert [count({"i": {"$gt": x}}) for x in (1, 1.5, 1 << 40, -(1 << 40))] == [1, 1, 0, 2]
    assert [count({"i": x}) for x in (1.0, 1.5, "1", None, 1 << 70)] == [1, 0, 0, 1, 0]
    assert [count(q) for q in ({"d": {"$gte": 10**400}}, {"d": {"$lt": 10**400}}, {"d": {"$ne": 1.5}}, {"b": True}, {"b": {"$gt": True}}, {"s": {"$nin": ["a"]}}, {"s": {"$nin": ["a", None]}}, {"s": {"$in": [None]}})] == [0, 2, 2, 1, 0, 2, 1, 1]
    nested = df.select(F.struct("i", "s").alias("x"), F.array("i").alias("y"))
    assert [find(nested, q).count() for q in ({"x.i": 1}, {"x.none": None}, {"x.none": 1}, {"y": [1]}, {"x": {"i": 1, "s": "a"}})] == [1, 3, 0, 1, 1]


@pytest.mark.parametrize("text", ['{"$lt":8}', '{"a":{"$":1}}', '{"a":{"$t":1}}', '{"a":{"$lt":1,"b":2}}', "[]", "4", "null", '{"a":{"$in":{}}}', '{"a":{"$nin":3}}', '{"a":1,"a":2}', '{"a":1e999}', '{"a":NaN}', '{"a":1}x', ""])
def test_raises(text):
    with pytest.raises(FilterError):
        parse_filter(text)


_json = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["", "a", "$lt", "$in", "$ne", "$x", "a.b", "`"]), c, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(_json)
def test_check_filter_is_total(value):
    try:
        check_filter(value)
    except FilterError:
        pass


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}[]":,$ltin0123.e-a \\', max_size=25))
def test_parse_filter_is_total(text):
    try:
        parse_filter(text)
    except FilterError:
        pass


def test_documents(spark, docs, tmp_path):
    lines = spark.createDataFrame([('{"_id":1}',), ("[1]",), ('{"a":1,"a":2}',), ("x",), (None,), ('{"_id":{"k":1},"n":4}',)], "value string")
    assert sorted(r["_id"] for r in parse_documents(lines).collect()) == ["1", '{"k":1}']
    assert rejected(lines).count() == 4
    assert docs.where(has_field("a")).count() == 14
    out = shred(docs, {"a": "bigint"})
    assert find(out, {"a": {"$gte": 3}}).where("_id = '1'").count() == 1
    from fernglass.sources.documents import read_documents, write_documents

    write_documents(docs, str(tmp_path / "d"))
    assert sorted(json.dumps(r[0]) for r in read_documents(spark, str(tmp_path / "d")).select("_id").collect()) == sorted(json.dumps(r[0]) for r in docs.select("_id").collect())


def test_collection(spark):
    c = Collection(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, s string"))
    assert [r["i"] for r in c.find({"s": "b"}, FindOptions(select=("i",), order_by=(("i", False),), limit=1)).collect()] == [3]
    assert [r["i"] for r in c.find({}, FindOptions(order_by=(("i", True),), skip=2)).collect()] == [3]
    done = c.update({"s": "b"}, {"i": F.col("i") * 10})
    assert (done.matched, sorted(r["i"] for r in done.collection.rows.collect())) == (2, [1, 20, 30])
    assert c.delete({"s": "b"}).count({}) == 1
    assert c.insert(spark.createDataFrame([(4,)], "i int")).count({"s": None}) == 1


def test_keys_of_any_characters(spark):
    keys = ['a"b', "a'b", "a]b", "a\\b", "a b", "$.a", ""]
    lines = spark.createDataFrame([(json.dumps({"_id": i, k: i, "in": {k: {"x": i}}}),) for i, k in enumerate(keys)], "value string")
    docs = parse_documents(lines)
    for i, k in enumerate(keys):
        assert [r["_id"] for r in docs.where(has_field(k)).collect()] == [str(i)]
        assert [r["_id"] for r in shred(docs, {k: "int"}).where(F.col(f"`{k}`") == i).collect()] == [str(i)] if k else True
        if not k.startswith("$"):
            assert [r["_id"] for r in find(docs, {k: i}, variant="doc", literal_keys=True).collect()] == [str(i)]
        if "." not in k:
            assert [r["_id"] for r in find(docs, {f"in.{k}.x": i}, variant="doc").collect()] == [str(i)]


def test_collection_of_documents(docs):
    c = Collection(docs, "doc")
    ids = lambda rows: [int(r["_id"]) for r in rows.collect()]
    assert ids(c.find({"_id": {"$in": ["2", "3", "4", "5", "7", "8", "9", "10"]}}, FindOptions(order_by=(("doc.a", True),)))) == [10, 2, 5, 3, 4, 8, 7, 9]
    assert ids(c.find({"a": {"$gt": 3}}, FindOptions(order_by=(("a", False),), skip=1, limit=2))) == [3, 5]
    assert [r["a.b"] for r in c.find({"a.b": 3}, FindOptions(select=("a.b",))).select(F.col("`a.b`").cast("int").alias("a.b")).collect()] == [3]
    done = c.update({"a": 3}, {"a": {"new": [1, None]}, "x.y": F.lit("z")})
    assert done.matched == 1 and done.collection.count({"a": {"new": [1, None]}, "x": {"y": "z"}}) == 1 and done.collection.count({}) == 16
    assert done.collection.count({"x.y": None}) == 15
    deep = c.update({"a.b": 3}, {"a.c": F.array(F.lit(5)), "a.b": None}).collection
    assert deep.count({"a": {"b": None, "c": [5]}}) == 1
    with pytest.raises(OptionError):
        Collection(docs.select("_id")).update({}, {"none": 1})
    with pytest.raises(OptionError):
        Collection(docs.select("_id")).find({}, FindOptions(order_by=(("none", True),)))


def test_stream_of_documents(spark, tmp_path):
    from fernglass.streaming.documents import find_stream, read_document_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*LINES, "no json"]))
    query = find_stream(read_document_stream(spark, str(tmp_path / "in")), {"a": {"$gte": 7.3}}).select("_id").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r[0] for r in spark.table("found").collect()) == ["3", "4", "5"]
