import os

import duckdb
import pytest

from fernglass.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(columns).collect())
    assert got == sorted(str(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall())


def test_filters_are_pushed_down(spark):
    plan = Q.QUERIES["multi_op"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(user_id,3)" in plan and "LessThan(user_id,5)" in plan


def test_json_is_parsed_once(spark):
    for name in ("variant_range", "variant_gte", "variant_object", "variant_nin"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.split("Filter", 1)[1].count("parseJson") <= 1 or plan.split("Filter", 1)[1].splitlines()[0].count("parseJson") <= 1, plan
