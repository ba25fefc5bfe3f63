"""Registered queries against their SQL on the smallest tables, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle
from lumenframe.plans.registry import QUERIES, table

FOLDER = "/root/testdata/sf0.001"
# Long-running families have their own tests; the full set runs with check_oracle.py.
SLOW = ("Q", "J9", "J15", "L6", "O7")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check_oracle.TABLES.split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql and not n.startswith(SLOW)])
def test_query_matches_sql(spark, duck, name):
    problem = check_oracle.compare(spark, duck, FOLDER, name, QUERIES[name].run, QUERIES[name].sql)
    assert problem is None, problem


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = QUERIES["flagship_segment_revenue"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "p_name" not in plan and "l_comment" not in plan


def test_no_python_in_relational_plans(spark):
    for name in ("E12_segment_leaderboard", "B2_calculated_column", "M14_text_features", "I16_mask_secrets", "F1_rank_dense"):
        plan = QUERIES[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_tables_load(spark):
    assert table(spark, FOLDER, "region").count() == 5


def test_sparse_series_hold_all_orders(spark):
    orders = table(spark, FOLDER, "orders").toPandas()
    series = QUERIES["O2_O3_resample_day_per_customer"].run(spark, FOLDER).toPandas()
    assert set(series["o_custkey"]) == set(orders["o_custkey"]) and series["empty"].sum() > 0
    assert abs(series["value"].sum() - orders["o_totalprice"].sum()) < 0.01 * len(series)
    assert (series["periods"] - series["empty"]).sum() == len(orders.assign(day=orders["o_orderdate"].dt.date).drop_duplicates(["o_custkey", "day"]))
