"""Every query against its oracle, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(float(r[k]) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


def by_k(rows, n="1"):
    return {r["k"]: r["n"] for r in rows.selectExpr("cast(k AS int) AS k", f"{n} AS n").groupBy("k").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}


def whole_combos(got):
    assert by_k(got.selectExpr("substring(combo, 1, 2) AS k", "n"), "n") == {1: 10, 2: 20, 3: 61}


def one_row_a_result(got):
    assert by_k(got) == {1: 10, 2: 20, 3: 61}


def all_develop(got):
    one_row_a_result(got)
    assert got.filter("error IS NOT NULL").count() == 0


#: What holds for the queries that no SQL can express.
NO_SQL = {"enum_combo_counts": whole_combos, "result_texts": one_row_a_result, "tiling_documents": one_row_a_result, "lattice_records": all_develop}


@pytest.mark.parametrize("name", sorted(entry.plans.ALL))
def test_query_against_oracle(spark, duck, name):
    query, sql = entry.plans.ALL[name]
    got = query(spark, SF)
    if sql is None:
        NO_SQL[name](got)
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal([tuple(r) for r in got.collect()], got.columns) == normal(want.fetchall(), want.columns)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["k", "m", "n", "entropy"] and out.count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.plans.ALL["both_sides_diff"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_range_anti_join_is_an_equi_join(spark):
    plan = entry.plans.ALL["range_anti_join"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
