"""Sources, projections, filters, joins, aggregates, sampling and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.functions import maths
from lumenframe.operators import aggregates as ag, filters as fl, joins as jn, projection as pj, sampling as sp, sets as st, timed_joins as tj
from lumenframe.operators.windows import top_k_per_group
from lumenframe.plans.registry import query, r, rounded, show, table
from lumenframe.session import ensure_checkpoint_dir
from lumenframe.sources import writers
from lumenframe.sources.files import find_documents, flatten_documents, json_items, load
from lumenframe.sources.relational import query_table, session_schema

FLAGSHIP_SQL = f"""
with sales as (
  select c.c_mktsegment as segment, n.n_name as nation, l.l_extendedprice * (1 - l.l_discount) as revenue
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey
  where l.l_shipdate <= timestamp '1998-09-02'),
totals as (select segment, nation, sum(revenue) as revenue, count(*) as n from sales group by segment, nation)
select segment, nation, {r('revenue', 2)} as revenue, cast(n as bigint) as n,
  {r('100 * revenue / (select sum(revenue) from totals)')} as share_pct
from totals order by revenue desc limit 20"""


@query("flagship_segment_revenue", FLAGSHIP_SQL)
def flagship(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    sales = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    totals = sales.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n"))
    grand = totals.agg(F.sum("revenue")).scalar()
    out = sp.top_n(totals.withColumn("share_pct", F.col("revenue") * 100 / grand), "revenue", 20, ["segment", "nation"])
    return out.select("segment", "nation", rounded("revenue", 2).alias("revenue"), "n", rounded("share_pct").alias("share_pct"))


# ---- sources -------------------------------------------------------------------------------

@query("A5_nested_documents", """
select event_id, cast(json_extract(props, '$.k') as bigint) as "props.k", event_type from events""")
def nested_documents(spark, d):
    docs = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"), "event_type")
    return flatten_documents(docs)


@query("A15_find_documents", """
select event_id, cast(json_extract(props, '$.k') as bigint) as "props.k" from events
where event_type = 'click' and cast(json_extract(props, '$.k') as bigint) >= 50""")
def find(spark, d):
    docs = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    return find_documents(docs, {"event_type": "click", "props.k": {"$gte": 50}}, {"event_id": 1, "props": 1})


@query("A24_preview_page", """
select o_orderkey, o_custkey, o_totalprice from orders
order by o_totalprice desc, o_orderkey limit 50 offset 100""")
def preview(spark, d):
    page = sp.preview(table(spark, d, "orders"), 3, 50, "o_totalprice", False, ["o_orderkey"])
    return page.select("o_orderkey", "o_custkey", "o_totalprice")


# What each nation's customers paid for orders that are finished, kept as a view that joins, filters, groups and rounds.
PAID = """select n.n_name as nation, count(distinct finished.o_custkey) as buyers, count(*) as finished_orders, {mean} as mean_order
  from (select o_custkey, o_totalprice from orders where o_orderstatus = 'F') finished
  join customer buyer on buyer.c_custkey = finished.o_custkey join nation n on n.n_nationkey = buyer.c_nationkey group by n.n_name"""


@query("A25_customer_revenue_view", PAID.format(mean=r("avg(finished.o_totalprice)", 2)))
def customer_revenue(spark, d):
    for name in ("orders", "customer", "nation"):
        table(spark, d, name).createOrReplaceTempView(name)
    spark.sql(f"create or replace temporary view paid_by_nation as {PAID.format(mean='avg(finished.o_totalprice)')}")
    return show(spark.table("paid_by_nation"), 2)


def _folder(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("A1_A2_A21_csv_round_trip", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def csv_round_trip(spark, d):
    path = _folder(spark, "orders.csv")
    writers.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path)
    return load(spark, path, "csv")


@query("A3_A4_delimited_text", "select p_partkey, p_name, p_size from part")
def delimited(spark, d):
    path = _folder(spark, "part.txt")
    table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("p_size")).write.option(
        "header", True).option("sep", "\t").csv(path)
    return load(spark, path, "txt").withColumn("p_size", F.col("p_size").cast("int"))


@query("A6_A22_json_records", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 1000")
def json_records(spark, d):
    path = _folder(spark, "orders.jsonl")
    writers.write_json_records(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, 1000, "o_orderkey")
    return load(spark, path, "jsonl")


@query("A7_A20_parquet_and_batches", "select cast(count(*) as bigint) as n from customer")
def parquet_round_trip(spark, d):
    path = _folder(spark, "customer")
    writers.write_parquet(table(spark, d, "customer"), path, partition_by=["c_mktsegment"])
    return load(spark, path, "parquet").agg(F.count(F.lit(1)).alias("n"))


@query("A14_table_listing", """
select 'region' as table_name, unnest(['r_regionkey', 'r_name']) as column_name, unnest(['int', 'string']) as data_type, unnest([1, 2]) as position, (select count(*) from region) as row_count
union all select 'supplier', unnest(['s_suppkey', 's_name', 's_nationkey', 's_acctbal']), unnest(['bigint', 'string', 'int', 'double']), unnest([1, 2, 3, 4]), (select count(*) from supplier)""")
def listing(spark, d):
    tables = {n: table(spark, d, n) for n in ("region", "supplier")}
    return session_schema(spark, tables, count_rows=True).drop("nullable")


@query("A23_sql_over_a_table", f"select o_orderstatus, cast(count(*) as bigint) as n, {r('avg(o_totalprice)', 3)} as mean from orders group by 1 having count(*) > 10")
def sql_text(spark, d):
    return show(query_table(table(spark, d, "orders"), "select o_orderstatus, count(*) as n, avg(o_totalprice) as mean from df group by 1 having count(*) > 10"), 3)


@query("P7_ready_made_steps", f"""
with t as (select distinct p_brand, p_size, p_retailprice, p_retailprice / (p_size + 1) as ratio from part where p_retailprice > (select avg(p_retailprice) from part)),
g as (select p_brand, cast(count(*) as bigint) as n, avg(ratio) as mean_ratio from t group by 1)
select p_brand, n, {r('mean_ratio')} as mean_ratio from g order by mean_ratio desc, p_brand limit 20""")
def ready_made(spark, d):
    t = pj.select_rename_drop(fl.above_mean(table(spark, d, "part"), "p_retailprice"), ["p_brand", "p_size", "p_retailprice"])
    t = pj.calculated_column(st.dedup(t), "ratio", "p_retailprice / (p_size + 1)")
    g = t.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean_ratio"))
    return show(sp.top_n(g, "mean_ratio", 20, ["p_brand"]))


# ---- projections -----------------------------------------------------------------------------

@query("B1_select_rename_drop", "select o_orderkey as order_id, o_totalprice as price, o_orderstatus from orders")
def select_rename_drop(spark, d):
    return pj.select_rename_drop(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus", "nope"],
                                 {"o_orderkey": "order_id", "o_totalprice": "price"}, ["o_orderdate"])


@query("B2_calculated_column", f"""
select l_orderkey, l_linenumber, {r('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} as charge from lineitem""")
def calculated(spark, d):
    out = pj.calculated_column(table(spark, d, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return show(out.select("l_orderkey", "l_linenumber", "charge"))


@query("B3_pair_math", f"""
with t as (select c_custkey, coalesce(case when c_custkey % 17 = 0 then null else c_acctbal end, 0) as a, c_nationkey as b from customer)
select c_custkey, {r('a / (b + 1e-5)', 1)} as divided, {r('a / (b + 1e-5) * 100', 0)} as percentage,
  {r('a * b', 2)} as multiplied, {r('a + b', 2)} as added, {r('a - b', 2)} as subtracted from t""")
def pair_math(spark, d):
    t = table(spark, d, "customer").withColumn("bal", F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal")))
    for op, name in (("multiply", "multiplied"), ("add", "added"), ("subtract", "subtracted")):
        t = maths.pair_math(t, "bal", "c_nationkey", op, name)
    a, b = F.coalesce("bal", F.lit(0.0)), F.col("c_nationkey")
    exact = {"divided": (a / (b + 1e-5), 1), "percentage": (a / (b + 1e-5) * 100, 0)}
    return t.select("c_custkey", *[rounded(c, n).alias(k) for k, (c, n) in exact.items()],
                    *[rounded(k, 2).alias(k) for k in ("multiplied", "added", "subtracted")])


@query("B3_divide_three_decimals", f"""
select l_orderkey, l_linenumber, {r('round(l_extendedprice / (l_quantity + 1e-5), 3)', 2)} as unit_price from lineitem""")
def divide(spark, d):
    t = maths.pair_math(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "divide", "unit_price")
    return t.select("l_orderkey", "l_linenumber", rounded("unit_price", 2).alias("unit_price"))


@query("B4_scale_by", f"select o_orderkey, {r('o_totalprice * 0.25', 2)} as scaled from orders")
def scale_by(spark, d):
    t = maths.scale_by(table(spark, d, "orders"), "o_totalprice", 0.25, "scaled")
    return t.select("o_orderkey", rounded("scaled", 2).alias("scaled"))


@query("B5_conditional_column", """
select o_orderkey, case when o_totalprice >= 250000 then 'high' else 'low' end as band,
  case when o_orderstatus <> 'F' then 1 else 0 end as is_open from orders""")
def conditional(spark, d):
    t = pj.conditional_column(table(spark, d, "orders"), "band", "o_totalprice", ">=", 250000, "high", "low")
    return pj.conditional_column(t, "is_open", "o_orderstatus", "!=", "F", 1, 0).select("o_orderkey", "band", "is_open")


@query("B6_B9_combine_columns", """
select c_custkey, c_name || ' / ' || coalesce(case when c_custkey % 17 = 0 then null else c_mktsegment end, '') as combined
from customer""")
def combine(spark, d):
    t = table(spark, d, "customer").withColumn("seg", F.when(F.col("c_custkey") % 17 != 0, F.col("c_mktsegment")))
    return pj.combine_columns(t, ["c_name", "seg"], " / ").select("c_custkey", "combined")


@query("B7_constant_and_copy", "select s_suppkey, 'EU' as zone, s_acctbal as balance_copy from supplier")
def constant(spark, d):
    t = pj.constant_column(table(spark, d, "supplier"), "zone", "EU")
    return pj.copy_column(t, "s_acctbal", "balance_copy").select("s_suppkey", "zone", "balance_copy")


@query("B8_split_column", """
select p_partkey, split_part(p_name, ' ', 1) as p_name_part_1, split_part(p_name, ' ', 2) as p_name_part_2 from part""")
def split_column(spark, d):
    out = pj.split_column(table(spark, d, "part"), "p_name", " ")
    return out.select("p_partkey", "p_name_part_1", "p_name_part_2")


@query("B10_convert_types", """
select event_id, cast(user_id as varchar) as user_id, try_cast(event_type as double) as event_type,
  case when value is null then null else value <> 0 end as value, try_cast(cast(ts as varchar) as timestamp) as ts from events""")
def convert(spark, d):
    t = table(spark, d, "events").withColumn("ts", F.col("ts").cast("string"))
    out = pj.convert_types(t, {"user_id": "string", "event_type": "numeric", "value": "bool", "ts": "datetime"})
    return out.select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


# ---- filters -----------------------------------------------------------------------------------

GAPPY = "(select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, case when o_orderkey % 17 = 0 then null else o_totalprice end as price from orders)"


def gappy_orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("price"))


for name, op, sign, limit in (("eq", "==", "=", 473274.17), ("gt", ">", ">", 180005.46), ("ge", ">=", ">=", 473274.17),
                              ("lt", "<", "<", 180005.46), ("le", "<=", "<=", 473274.17)):
    query(f"C1_filter_{name}", f"select o_orderkey, price from {GAPPY} where price {sign} {limit}")(
        lambda spark, d, op=op, limit=limit: fl.filter_rows(gappy_orders(spark, d), "price", op, limit).select("o_orderkey", "price"))


@query("C1_filter_ne_keeps_null", f"select o_orderkey, price from {GAPPY} where price is distinct from 112946.26")
def filter_ne(spark, d):
    return fl.filter_rows(gappy_orders(spark, d), "price", "!=", 112946.26).select("o_orderkey", "price")


@query("C2_filter_text", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority <> '5-LOW'")
def filter_text(spark, d):
    t = fl.filter_rows(table(spark, d, "orders"), "o_orderstatus", "==", "F")
    return fl.filter_rows(t, "o_orderpriority", "!=", "5-LOW").select("o_orderkey")


@query("C3_C4_text_match", """
select p_partkey, p_name from part where regexp_matches(p_name, 'RED|blue', 'i')
  and not starts_with(p_name, 'small') and (ends_with(p_name, 'ring') or starts_with(p_name, 'b'))""")
def text_match(spark, d):
    t = fl.filter_rows(table(spark, d, "part"), "p_name", "contains", "RED|blue")
    t = t.where(~fl.predicate(t, "p_name", "startswith", "small"))
    return t.where(fl.predicate(t, "p_name", "endswith", "ring") | fl.predicate(t, "p_name", "startswith", "b")).select(
        "p_partkey", "p_name")


@query("C5_isin", "select n_nationkey, n_name from nation where n_regionkey in (1, 3)")
def isin(spark, d):
    return fl.filter_rows(table(spark, d, "nation"), "n_regionkey", "isin", "1, 3").select("n_nationkey", "n_name")


@query("C6_null_checks", f"select o_orderkey, price is null as gap from {GAPPY}")
def null_checks(spark, d):
    t = gappy_orders(spark, d)
    gaps = fl.filter_rows(t, "price", "isnull").select("o_orderkey", F.lit(True).alias("gap"))
    return gaps.union(fl.filter_rows(t, "price", "notnull").select("o_orderkey", F.lit(False).alias("gap")))


@query("C7_multi_filter", f"""
select 'and' as logic, o_orderkey from {GAPPY} where price > 200000 and o_orderstatus = 'O'
union all select 'or', o_orderkey from {GAPPY} where price > 450000 or o_orderpriority = '1-URGENT'""")
def multi_filter(spark, d):
    t = gappy_orders(spark, d)
    a = fl.multi_filter(t, [{"column": "price", "operator": ">", "value": 200000},
                            {"column": "o_orderstatus", "operator": "==", "value": "O"},
                            {"column": "unknown", "operator": "==", "value": 1}])
    b = fl.multi_filter(t, [{"column": "price", "operator": ">", "value": 450000},
                            {"column": "o_orderpriority", "operator": "==", "value": "1-URGENT"}], "OR")
    return a.select(F.lit("and").alias("logic"), "o_orderkey").union(b.select(F.lit("or").alias("logic"), "o_orderkey"))


@query("C8_search_rows", """
select p_partkey from part where regexp_matches(concat_ws('\x01', cast(p_partkey as varchar), p_name, p_brand, p_type,
  cast(p_size as varchar)), 'econ|#2', 'i')""")
def search_rows(spark, d):
    return fl.search_rows(table(spark, d, "part").drop("p_retailprice"), "econ|#2").select("p_partkey")


@query("C9_above_mean", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)")
def above_mean(spark, d):
    return fl.above_mean(table(spark, d, "orders"), "o_totalprice").select("o_orderkey")


@query("C10_geo_range", """
select c_custkey from customer where c_acctbal / 50 between -90 and 90 and (c_custkey % 500) - 250 between -180 and 180""")
def geo_range(spark, d):
    t = table(spark, d, "customer").withColumns({"lat": F.col("c_acctbal") / 50, "lon": F.col("c_custkey") % 500 - 250})
    return fl.in_geo_range(t, "lat", "lon").select("c_custkey")


@query("C11_value_share", f"""
select cast(count(*) filter (where o_orderstatus = 'F') as bigint) as matching,
  {r("100.0 * count(*) filter (where o_orderstatus = 'F') / count(*)")} as pct,
  cast(count(*) - count(*) filter (where o_orderstatus = 'F') as bigint) as remaining from orders""")
def value_share(spark, d):
    return show(fl.value_share(table(spark, d, "orders"), "o_orderstatus", "F"))


@query("C12_drop_null_rows", f"select o_orderkey, price from {GAPPY} where price is not null")
def drop_nulls(spark, d):
    t = fl.drop_null_rows(gappy_orders(spark, d), ["price"])
    return fl.drop_columns(t, ["o_custkey", "o_orderstatus", "o_orderpriority"])


# ---- joins -------------------------------------------------------------------------------------

def keyed(spark, d):
    """Customers and suppliers keyed by nation, with some null keys on both sides."""
    a = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 13 != 0, F.col("s_nationkey")).alias("k"),
                                           F.col("s_acctbal").alias("bal"))
    b = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 11 != 0, F.col("n_nationkey")).alias("k"), "n_name",
                                         F.col("n_regionkey").cast("double").alias("bal"))
    return a, b


SIDES = """with a as (select s_suppkey, case when s_suppkey % 13 = 0 then null else s_nationkey end as k, s_acctbal as bal from supplier),
b as (select case when n_nationkey % 11 = 0 then null else n_nationkey end as k, n_name, cast(n_regionkey as double) as bal from nation) """

for number, how, words, key in (("D1", "inner", "join", "a.k"), ("D2", "left", "left join", "a.k"),
                                ("D3", "right", "right join", "coalesce(a.k, b.k)"), ("D4", "outer", "full join", "coalesce(a.k, b.k)")):
    query(f"{number}_{how}_join", SIDES + f"""select {key} as k, a.s_suppkey, a.bal as bal_x, b.n_name, b.bal as bal_y
from a {words} b on a.k is not distinct from b.k""")(lambda spark, d, how=how: jn.join(*keyed(spark, d), "k", how=how))


@query("D1_join_two_key_names", """select o_orderkey, o_custkey, c_custkey, c_name from orders join customer on o_custkey = c_custkey""")
def join_names(spark, d):
    return jn.join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey").select(
        "o_orderkey", "o_custkey", "c_custkey", "c_name")


@query("D5_cross_join", "select r_name, n_name from region, nation")
def cross_join(spark, d):
    return jn.join(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"), how="cross")


PURCHASE_VIEW = """(select event_id, user_id, ts from events where event_type = 'purchase') p
  asof left join (select event_id as view_id, user_id, ts as view_ts from events where event_type = 'view') v on p.user_id = v.user_id and p.ts {sign} v.view_ts"""


def purchases_and_views(spark, d):
    events = table(spark, d, "events")
    return (events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"),
            events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts")))


@query("D6_asof_last_view", f"select p.event_id, p.user_id, p.ts, v.view_id, v.view_ts from {PURCHASE_VIEW.format(sign='>=')}")
def asof_last(spark, d):
    return tj.asof_join(*purchases_and_views(spark, d), "ts", "view_ts", "user_id", tie="view_id")


@query("D6_asof_next_view_in_half_a_day", f"""
select event_id, user_id, ts, case when near then view_id end as view_id, case when near then view_ts end as view_ts
from (select p.*, v.view_id, v.view_ts, v.view_ts - p.ts <= interval 12 hours as near from {PURCHASE_VIEW.format(sign='<=')})""")
def asof_next(spark, d):
    return tj.asof_join(*purchases_and_views(spark, d), "ts", "view_ts", "user_id", direction="forward", tolerance="12 hours", tie="view_id")


OPEN = """(select o_orderkey, o_custkey, o_orderdate, max(l_shipdate) as done from orders join lineitem on l_orderkey = o_orderkey group by all)"""


def open_orders(spark, d):
    done = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("done"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(done, "o_orderkey")


@query("D6_interval_join_orders_placed_meanwhile", f"""
select p.o_orderkey as placed, w.o_orderkey as waiting, p.o_custkey, p.o_orderdate from orders p
join {OPEN} w on p.o_custkey = w.o_custkey and p.o_orderdate between w.o_orderdate and w.done where p.o_orderkey <> w.o_orderkey""")
def placed_meanwhile(spark, d):
    placed = table(spark, d, "orders").select(F.col("o_orderkey").alias("placed"), "o_custkey", "o_orderdate")
    waiting = open_orders(spark, d).select(F.col("o_orderkey").alias("waiting"), "o_custkey", F.col("o_orderdate").alias("since"), "done")
    return tj.interval_join(placed, waiting, "o_orderdate", "since", "done", "o_custkey").where("placed <> waiting").drop("since", "done")


@query("D6_overlap_join_open_orders", f"""
select a.o_custkey, a.o_orderkey as one, b.o_orderkey as other from {OPEN} a
join {OPEN} b on a.o_custkey = b.o_custkey and a.o_orderdate <= b.done and b.o_orderdate <= a.done
where a.o_orderkey < b.o_orderkey and a.o_orderdate <= a.done and b.o_orderdate <= b.done""")
def open_together(spark, d):
    orders = open_orders(spark, d)
    out = tj.overlap_join(orders, orders, ("o_orderdate", "done"), ("o_orderdate", "done"), "o_custkey")
    return out.where("o_orderkey_x < o_orderkey_y").select("o_custkey", F.col("o_orderkey_x").alias("one"), F.col("o_orderkey_y").alias("other"))


@query("D6_band_join_balances", """
select c_custkey, s_suppkey from customer join supplier on c_acctbal between s_acctbal - 25 and s_acctbal + 25""")
def balances(spark, d):
    bands = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - 25).alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return tj.interval_join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal", "low", "high").select("c_custkey", "s_suppkey")


@query("D6_semi_anti_join", """
select 'with' as kind, c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')
union all select 'without', c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')""")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'")
    with_orders = jn.join(c, o, "c_custkey", "o_custkey", "semi").select(F.lit("with").alias("kind"), "c_custkey")
    return with_orders.union(jn.join(c, o, "c_custkey", "o_custkey", "anti").select(F.lit("without").alias("kind"), "c_custkey"))


@query("D8_concat_columns", """
select coalesce(a.n_nationkey, b.n_nationkey) as n_nationkey, suppliers, customers from
(select s_nationkey as n_nationkey, count(*) as suppliers from supplier group by 1) a full join
(select c_nationkey as n_nationkey, count(*) as customers from customer group by 1) b on a.n_nationkey = b.n_nationkey""")
def concat_columns(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return jn.concat_columns([a, b], "n_nationkey")


# ---- aggregates ----------------------------------------------------------------------------------

@query("E1_E8_group_by_aggregate", f"""
select l_returnflag, l_linestatus, {r('sum(l_quantity)', 2)} as l_quantity_sum, {r('avg(l_extendedprice)')} as l_extendedprice_avg,
  {r('median(l_extendedprice)')} as l_extendedprice_median, min(l_discount) as l_discount_min, max(l_discount) as l_discount_max,
  cast(count(l_tax) as bigint) as l_tax_count, cast(count(distinct l_suppkey) as bigint) as l_suppkey_distinct_count,
  {r('stddev_samp(l_quantity)')} as l_quantity_std, {r('var_samp(l_quantity)')} as l_quantity_variance
from lineitem group by 1, 2""")
def group_by_aggregate(spark, d):
    return show(ag.group_by_aggregate(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {
        "l_quantity": ["sum", "std", "variance"], "l_extendedprice": ["avg", "median"], "l_discount": ["min", "max"],
        "l_tax": ["count"], "l_suppkey": ["distinct_count"]}))


@query("E9_pivot", f"""
select o_orderpriority, {r("avg(o_totalprice) filter (where o_orderstatus = 'F')")} as "F",
  {r("avg(o_totalprice) filter (where o_orderstatus = 'O')")} as "O", {r("avg(o_totalprice) filter (where o_orderstatus = 'P')")} as "P"
from orders group by 1""")
def pivot(spark, d):
    return show(ag.pivot(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "mean"))


@query("E10_crosstab", "select o_orderpriority, o_orderstatus, cast(count(*) as bigint) as n from orders group by 1, 2")
def crosstab(spark, d):
    return ag.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("E11_value_counts", f"""
select p_brand, cast(count(*) as bigint) as n, {r('100.0 * count(*) / (select count(p_brand) from part)')} as pct
from part where p_brand is not null group by 1""")
def value_counts(spark, d):
    return show(ag.value_counts(table(spark, d, "part"), "p_brand"))


@query("E12_segment_leaderboard", f"""
select p_brand as segment, {r('sum(p_retailprice)', 2)} as total, {r('avg(p_retailprice)')} as average, cast(count(*) as bigint) as n,
  {r('100 * sum(p_retailprice) / (select sum(p_retailprice) from part)')} as share_pct from part group by 1""")
def leaderboard(spark, d):
    out = show(ag.segment_leaderboard(table(spark, d, "part"), "p_brand", "p_retailprice"))
    return out.withColumn("total", rounded("total", 2))


@query("E13_group_compare", f"""
select c_mktsegment as segment, {r('sum(c_acctbal)', 2)} as sum, {r('avg(c_acctbal)')} as mean, cast(count(*) as bigint) as n
from customer group by 1""")
def group_compare(spark, d):
    return show(ag.group_compare(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")).withColumn("sum", rounded("sum", 2))


HISTOGRAM_SQL = f"""
with b as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 30 as w from orders),
c as (select least(cast(floor((o_totalprice - lo) / w) as int), 29) as bin, count(*) as n from orders, b group by 1)
select cast(i.bin as int) as bin, {r('lo + i.bin * w', 2)} as low, {r('lo + (i.bin + 1) * w', 2)} as high, cast(coalesce(n, 0) as bigint) as n
from (select unnest(range(30)) as bin) i cross join b left join c on c.bin = i.bin"""


@query("E14_histogram", HISTOGRAM_SQL)
def histogram(spark, d):
    return show(ag.histogram(table(spark, d, "orders"), "o_totalprice", 30), 2)


@query("E16_box_summary", f"""
with q as (select l_returnflag, min(l_extendedprice) as min, quantile_cont(l_extendedprice, 0.25) as q1, median(l_extendedprice) as median,
  quantile_cont(l_extendedprice, 0.75) as q3, max(l_extendedprice) as max, count(*) as n from lineitem group by 1)
select q.l_returnflag, {r('min', 2)} as min, {r('q1')} as q1, {r('median')} as median, {r('q3')} as q3, {r('max', 2)} as max, cast(n as bigint) as n,
  cast((select count(*) from lineitem l where l.l_returnflag = q.l_returnflag and
  (l_extendedprice < q1 - 1.5 * (q3 - q1) or l_extendedprice > q3 + 1.5 * (q3 - q1))) as bigint) as outliers from q""")
def box(spark, d):
    out = show(ag.box_summary(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))
    return out.withColumns({"min": rounded("min", 2), "max": rounded("max", 2)})


@query("E17_hierarchy_totals", f"""
select r_name, n_name, {r('sum(s_acctbal)', 2)} as total,
  cast(case when grouping(r_name) = 1 then 0 when grouping(n_name) = 1 then 1 else 2 end as int) as level
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def hierarchy(spark, d):
    t = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return show(ag.hierarchy_totals(t, ["r_name", "n_name"], "s_acctbal"), 2)


PARETO = """t as (select p_brand as segment, sum(p_retailprice) as total from part group by 1),
p as (select segment, total, sum(total) over (order by total desc, segment) as cumulative,
  row_number() over (order by total desc, segment) as position, sum(total) over () as grand from t)"""


@query("E18_pareto", f"""with {PARETO} select segment, {r('total', 2)} as total, {r('cumulative', 2)} as cumulative,
  cast(position as bigint) as position, {r('100 * cumulative / grand')} as cumulative_pct from p""")
def pareto(spark, d):
    out = show(ag.pareto(table(spark, d, "part"), "p_brand", "p_retailprice"))
    return out.select("segment", rounded("total", 2).alias("total"), rounded("cumulative", 2).alias("cumulative"),
                      F.col("position").cast("bigint").alias("position"), "cumulative_pct")


@query("E18_concentration", f"""with {PARETO} select cast(count(*) as bigint) as segments, {r('sum(total)', 2)} as top_total,
  {r('100 * sum(total) / max(grand)')} as top_pct from p where position <= greatest(1, floor(0.2 * (select count(*) from t)))""")
def concentration(spark, d):
    out = show(ag.concentration(table(spark, d, "part"), "p_brand", "p_retailprice"))
    return out.withColumn("top_total", rounded("top_total", 2))


@query("E19_funnel", f"""
with c as (select event_type as stage, count(distinct user_id) as users,
  case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end as position
  from events where event_type in ('view', 'click', 'purchase') group by 1)
select cast(position as int) as position, stage, cast(users as bigint) as users,
  {r('100.0 * users / lag(users) over (order by position)')} as pct_of_previous,
  {r('100.0 * users / first_value(users) over (order by position)')} as pct_of_first from c""")
def funnel(spark, d):
    return show(ag.funnel(table(spark, d, "events"), "user_id", "event_type", ["view", "click", "purchase"]))


@query("E20_waterfall", f"""
with t as (select o_orderpriority as step, sum(o_totalprice) as change from orders group by 1),
w as (select step, change, sum(change) over (order by step) as level_after from t)
select step, {r('change', 2)} as change, {r('level_after - change', 1)} as level_before, {r('level_after', 1)} as level_after from w""")
def waterfall(spark, d):
    out = ag.waterfall(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("step", rounded("change", 2).alias("change"), rounded("level_before", 1).alias("level_before"),
                      rounded("level_after", 1).alias("level_after"))


@query("E21_cube", f"""
select o_orderstatus, o_orderpriority, cast(count(*) as bigint) as n, {r('sum(o_totalprice)', 2)} as total
from orders group by cube (o_orderstatus, o_orderpriority)""")
def cube(spark, d):
    return show(query_table(table(spark, d, "orders"), """
        select o_orderstatus, o_orderpriority, count(*) as n, sum(o_totalprice) as total
        from df group by cube (o_orderstatus, o_orderpriority)"""), 2)


@query("E22_kpi_totals", f"""select {r('sum(o_totalprice)', 2)} as sum, {r('avg(o_totalprice)', 2)} as mean,
  cast(count(o_totalprice) as bigint) as n, {r('min(o_totalprice)', 2)} as min, {r('max(o_totalprice)', 2)} as max from orders""")
def kpi_totals(spark, d):
    return show(ag.kpi_totals(table(spark, d, "orders"), "o_totalprice"), 2)


@query("E23_place_mean", f"""
select n_name as place, {r('avg(c_acctbal)')} as mean, cast(count(*) as bigint) as n
from customer join nation on c_nationkey = n_nationkey group by 1 order by avg(c_acctbal) desc, 1 limit 10""")
def place_mean(spark, d):
    t = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return show(ag.place_mean(t, "n_name", "c_acctbal", 10))


# ---- sort, top-k, samples ----------------------------------------------------------------------------

@query("G1_sort", f"select o_orderkey, o_orderpriority, price from {GAPPY}")
def sort(spark, d):
    return sp.sort(gappy_orders(spark, d), [{"column": "o_orderpriority"}, {"column": "price", "ascending": False},
                                            {"column": "o_orderkey"}]).select("o_orderkey", "o_orderpriority", "price")


@query("G2_head_tail", """
select 'head' as part, o_orderkey from (select o_orderkey from orders order by o_orderdate, o_orderkey limit 25)
union all select 'tail', o_orderkey from (select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 25)""")
def head_tail(spark, d):
    o, keys = table(spark, d, "orders"), ["o_orderdate", "o_orderkey"]
    return sp.head(o, 25, keys).select(F.lit("head").alias("part"), "o_orderkey").union(
        sp.tail(o, 25, keys).select(F.lit("tail").alias("part"), "o_orderkey"))


@query("G3_top_n", f"select o_orderkey, price from {GAPPY} where price is not null order by price desc, o_orderkey limit 20")
def top_n(spark, d):
    return sp.top_n(gappy_orders(spark, d), "price", 20, ["o_orderkey"]).select("o_orderkey", "price")


@query("G4_sample_fraction")
def sample_fraction(spark, d):
    return sp.sample_fraction(table(spark, d, "orders"), 0.1, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("G5_sample_n")
def sample_n(spark, d):
    return sp.sample_n(table(spark, d, "orders"), 100, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("G6_sample_stratified")
def sample_stratified(spark, d):
    return sp.sample_stratified(table(spark, d, "orders"), "o_orderstatus", {"F": 0.2, "O": 0.05}, ["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus")


@query("G7_best_and_worst", f"""
with t as (select n_name, sum(o_totalprice) as total from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey group by 1)
select (select n_name from t order by total desc, n_name limit 1) as top, {r('max(total)', 2)} as top_total,
  (select n_name from t order by total, n_name limit 1) as bottom, {r('min(total)', 2)} as bottom_total,
  {r('max(total) / greatest(1.0, min(total))')} as ratio from t""")
def best_worst(spark, d):
    t = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = ag.best_and_worst(t, "n_name", "o_totalprice")
    return out.select("top", rounded("top_total", 2).alias("top_total"), "bottom",
                      rounded("bottom_total", 2).alias("bottom_total"), rounded("ratio").alias("ratio"))


@query("F13_top_k_per_group", """
select c_mktsegment, c_custkey, c_acctbal, cast(rank as int) as rank from (
  select *, dense_rank() over (partition by c_mktsegment order by c_acctbal desc) as rank from customer) where rank <= 3""")
def top_k(spark, d):
    return top_k_per_group(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", 3).select(
        "c_mktsegment", "c_custkey", "c_acctbal", "rank")


# ---- sets -----------------------------------------------------------------------------------------------

@query("H1_union_all", """
select c_name as name, c_acctbal as bal, c_mktsegment as segment, cast(null as bigint) as s_suppkey from customer
union all select s_name, s_acctbal, null, s_suppkey from supplier""")
def union_all(spark, d):
    a = table(spark, d, "customer").selectExpr("c_name as name", "c_acctbal as bal", "c_mktsegment as segment")
    return st.union_all(a, table(spark, d, "supplier").selectExpr("s_suppkey", "s_name as name", "s_acctbal as bal"))


@query("H2_concat_inner", """
select key, nation from (select c_custkey as key, c_nationkey as nation from customer union all
select s_suppkey, s_nationkey from supplier union all select n_nationkey, n_nationkey from nation)""")
def concat_inner(spark, d):
    return st.concat([table(spark, d, "customer").selectExpr("c_custkey as key", "c_nationkey as nation", "c_name"),
                      table(spark, d, "supplier").selectExpr("s_suppkey as key", "s_nationkey as nation"),
                      table(spark, d, "nation").selectExpr("bigint(n_nationkey) as key", "n_nationkey as nation", "n_name")], "inner")


@query("H3_dedup", """
select 'first' as keep, l_returnflag, l_linestatus, l_quantity from (select distinct l_returnflag, l_linestatus, l_quantity from lineitem)
union all select 'drop_all', l_suppkey::varchar, l_returnflag, l_quantity from (
  select l_suppkey, l_returnflag, l_quantity from lineitem group by all having count(*) = 1)""")
def dedup(spark, d):
    t = table(spark, d, "lineitem")
    a = st.dedup(t.select("l_returnflag", "l_linestatus", "l_quantity")).select(F.lit("first").alias("keep"), "*")
    b = st.dedup(t.select(F.col("l_suppkey").cast("string").alias("l_returnflag"), F.col("l_returnflag").alias("l_linestatus"),
                          "l_quantity"), "drop_all")
    return a.union(b.select(F.lit("drop_all").alias("keep"), "*"))


@query("H4_intersect_except", """
select 'both' as kind, k from (select c_nationkey as k from customer intersect select s_nationkey from supplier)
union all select 'only_orders', o_custkey from (select c_custkey as o_custkey from customer except select o_custkey from orders)""")
def intersect_except(spark, d):
    for name in ("customer", "supplier", "orders"):
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql("""select 'both' as kind, bigint(k) as k from (select c_nationkey as k from customer intersect select s_nationkey from supplier)
        union all select 'only_orders', k from (select c_custkey as k from customer except select o_custkey from orders)""")


@query("H5_unpivot", f"""
select l_orderkey, l_linenumber, m.name as measure, m.value from lineitem, lateral (values
  ('l_quantity', l_quantity), ('l_discount', case when l_orderkey % 17 = 0 then null else l_discount end), ('l_tax', l_tax)) m(name, value)""")
def unpivot(spark, d):
    t = table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_orderkey") % 17 != 0, F.col("l_discount")))
    return st.unpivot(t, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")


@query("I35_json_items", """
select event_id, to_json({'k': json_extract(props, '$.k')}) as item from events""")
def items(spark, d):
    t = table(spark, d, "events").select("event_id", F.concat(F.lit('{"data": {"items": ['), "props", F.lit("]}}")).alias("body"))
    return json_items(t, "body", "data.items").select("event_id", F.to_json(F.from_json("item", "k bigint")).alias("item"))
