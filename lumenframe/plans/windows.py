"""Ranks, running and rolling columns over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import ordered, ranks, windows as wn
from lumenframe.operators.aggregates import value_counts
from lumenframe.plans.registry import query, r, show, table
from lumenframe.sources.relational import query_table

# A price that is missing for every 17th order, ordered by date and key.
PRICED = "(select o_orderkey, o_orderdate, o_orderstatus, case when o_orderkey % 17 = 0 then null else o_totalprice end as price from orders)"
ORDER = "order by o_orderdate, o_orderkey"
KEYS = ["o_orderdate", "o_orderkey"]


def priced(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus",
                                            F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("price"))


RANKS = {"dense": "dense_rank() over (order by l_quantity desc)", "min": "rank() over (order by l_quantity desc)",
         "max": "count(*) over (order by l_quantity desc)",
         "average": "cast(floor((rank() over (order by l_quantity desc) + count(*) over (order by l_quantity desc)) / 2.0) as bigint)"}
for _method, _sql in RANKS.items():
    query(f"F1_rank_{_method}", f"select l_orderkey, l_linenumber, l_quantity, cast({_sql} as bigint) as rank from lineitem")(
        lambda spark, d, m=_method: ranks.rank(table(spark, d, "lineitem"), "l_quantity", m, name="rank").select(
            "l_orderkey", "l_linenumber", "l_quantity", F.col("rank").cast("bigint").alias("rank")))


@query("F1_rank_first", """select o_orderkey, cast(row_number() over (order by o_orderdate desc, o_orderkey) as bigint) as rank from orders""")
def rank_first(spark, d):
    out = ranks.rank(table(spark, d, "orders"), "o_orderdate", "first", name="rank", tie_break="o_orderkey")
    return out.select("o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("F1_rank_by_group", """
select c_custkey, cast(dense_rank() over (partition by c_mktsegment order by c_nationkey) as bigint) as rank from customer""")
def rank_group(spark, d):
    out = ranks.rank(table(spark, d, "customer"), "c_nationkey", "dense", True, ["c_mktsegment"], "rank")
    return out.select("c_custkey", F.col("rank").cast("bigint").alias("rank"))


@query("F2_percent_rank", f"select l_orderkey, l_linenumber, {r('percent_rank() over (order by l_quantity desc)')} as rank from lineitem")
def percent_rank(spark, d):
    return show(ranks.rank(table(spark, d, "lineitem"), "l_quantity", "percent", name="rank").select(
        "l_orderkey", "l_linenumber", "rank"))


ROLLING = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}
for _fn, _sql in ROLLING.items():
    query(f"F3_F4_rolling_{_fn}", f"select o_orderkey, {r(f'{_sql}(price) over ({ORDER} rows 6 preceding)', 3)} as out from {PRICED}")(
        lambda spark, d, fn=_fn: show(wn.rolling(priced(spark, d), "price", fn, 7, KEYS, name="out").select("o_orderkey", "out"), 3))


@query("F3_rolling_mean_by_group", f"""
select o_orderkey, {r(f'avg(price) over (partition by o_orderstatus {ORDER} rows 2 preceding)', 3)} as out from {PRICED}""")
def rolling_group(spark, d):
    return show(wn.rolling(priced(spark, d), "price", "mean", 3, KEYS, ["o_orderstatus"], "out").select("o_orderkey", "out"), 3)


@query("F5_cumsum", f"select o_orderkey, case when price is not null then {r(f'sum(price) over ({ORDER} rows unbounded preceding)', 2)} end as out from {PRICED}")
def cumsum(spark, d):
    return show(wn.cumulative(priced(spark, d), "price", "cumsum", KEYS, name="out").select("o_orderkey", "out"), 2)


@query("F6_cumprod", f"""
select l_orderkey, l_linenumber, {r('exp(sum(ln(1 - l_discount / 1000)) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice rows unbounded preceding))')} as out
from lineitem""")
def cumprod(spark, d):
    t = table(spark, d, "lineitem").withColumn("keep", 1 - F.col("l_discount") / 1000)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return show(wn.cumulative(t, "keep", "cumprod", keys, name="out").select("l_orderkey", "l_linenumber", "out"))


@query("F7_expanding_mean", f"select o_orderkey, {r(f'avg(price) over ({ORDER} rows unbounded preceding)', 3)} as out from {PRICED}")
def expanding(spark, d):
    return show(wn.cumulative(priced(spark, d), "price", "expanding_mean", KEYS, name="out").select("o_orderkey", "out"), 3)


@query("F8_lag_lead", f"""
select o_orderkey, lag(price, 3) over ({ORDER}) as lag_3, lead(price, 2) over ({ORDER}) as lead_2 from {PRICED}""")
def lag_lead(spark, d):
    out = ordered.over_rows(priced(spark, d), {}, 0, 0, KEYS, shifts={"lag_3": ("price", 3), "lead_2": ("price", -2)})
    return out.select("o_orderkey", "lag_3", "lead_2")


@query("F9_pct_change", f"""
with f as (select o_orderkey, o_orderdate, last_value(price ignore nulls) over ({ORDER} rows unbounded preceding) as p from {PRICED})
select o_orderkey, {r(f'p / lag(p, 2) over ({ORDER}) - 1')} as out from f""")
def pct_change(spark, d):
    return show(wn.pct_change(priced(spark, d), "price", 2, KEYS, name="out").select("o_orderkey", "out"))


@query("F10_centred_mean", f"select o_orderkey, {r(f'avg(price) over ({ORDER} rows between 2 preceding and 1 following)', 3)} as out from {PRICED}")
def centred(spark, d):
    return show(wn.rolling(priced(spark, d), "price", "mean", 4, KEYS, name="out", centred=True).select("o_orderkey", "out"), 3)


@query("F11_J4_forward_backward_fill", f"""
select o_orderkey, last_value(price ignore nulls) over ({ORDER} rows unbounded preceding) as forward,
  first_value(price ignore nulls) over ({ORDER} rows between current row and unbounded following) as backward from {PRICED}""")
def fills(spark, d):
    return ordered.fill(priced(spark, d), {"forward": ("price", "forward"), "backward": ("price", "backward")}, KEYS).select(
        "o_orderkey", "forward", "backward")


@query("F11_fill_by_group", f"""
select o_orderkey, last_value(price ignore nulls) over (partition by o_orderstatus {ORDER} rows unbounded preceding) as forward from {PRICED}""")
def fill_group(spark, d):
    return ordered.fill(priced(spark, d), {"forward": ("price", "forward")}, KEYS, ["o_orderstatus"]).select("o_orderkey", "forward")


@query("F12_J5_interpolate", f"""
with n as (select *, row_number() over ({ORDER}) as rn from {PRICED}),
g as (select *, last_value(price ignore nulls) over w as a, last_value(case when price is not null then rn end ignore nulls) over w as ra,
  first_value(price ignore nulls) over v as b, first_value(case when price is not null then rn end ignore nulls) over v as rb from n
  window w as (order by rn rows unbounded preceding), v as (order by rn rows between current row and unbounded following))
select o_orderkey, {r('case when price is not null then price when b is null then a else a + (b - a) * (rn - ra) / (rb - ra) end')} as out from g""")
def interpolate(spark, d):
    out = ordered.interpolate(priced(spark, d), ["price"], KEYS)
    return show(out.select("o_orderkey", F.col("price").alias("out")))


@query("F14_sql_window_frames", f"""
select c_custkey, {r('sum(c_acctbal) over (partition by c_nationkey order by c_custkey range between 100 preceding and current row)', 2)} as near,
  cast(ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey) as int) as quarter from customer""")
def frames(spark, d):

    return show(query_table(table(spark, d, "customer"), """
        select c_custkey, sum(c_acctbal) over (partition by c_nationkey order by c_custkey range between 100 preceding and current row) as near,
        ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey) as quarter from df"""), 2)


@query("E15_ecdf", f"""
select l_quantity, cast(count(*) as bigint) as n, {r('cast(sum(count(*)) over (order by l_quantity) as double) / sum(count(*)) over ()')} as ecdf
from lineitem group by 1""")
def ecdf(spark, d):
    return show(ranks.ecdf(table(spark, d, "lineitem"), "l_quantity"))


@query("E15_ecdf_by_group", f"""
select l_returnflag, l_quantity, cast(count(*) as bigint) as n,
  {r('cast(sum(count(*)) over (partition by l_returnflag order by l_quantity) as double) / sum(count(*)) over (partition by l_returnflag)')} as ecdf
from lineitem group by 1, 2""")
def ecdf_group(spark, d):
    return show(ranks.ecdf(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]))


@query("E11_top_values", f"""
select event_type, cast(count(*) as bigint) as n, {r('100.0 * count(*) / (select count(*) from events)')} as pct
from events group by 1 order by n desc, event_type limit 3""")
def top_values(spark, d):
    return show(value_counts(table(spark, d, "events"), "event_type", 3))
