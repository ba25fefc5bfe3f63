"""Experiments, time series, business metrics and ready-made questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import business as bs, experiments as ex, timeseries as ts
from lumenframe.plans.registry import query, r, rounded, show, table
from lumenframe.sources.relational import query_table

ARMS = "(select user_id % 2 as arm, event_type, value, (event_type = 'purchase')::int as bought, cast(date_trunc('day', ts) as date)::varchar as day from events)"


def arms(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 2).alias("arm"), "event_type", "value",
                                            (F.col("event_type") == "purchase").cast("int").alias("bought"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _conversion(segment: str) -> str:
    keys, group = (f"{segment}, ", f"group by {segment}") if segment else ("", "")
    return f"""
with g as (select {keys}count(*) filter (where arm = 0) as n_c, count(*) filter (where arm = 1) as n_t, coalesce(sum(bought) filter (where arm = 0), 0) as x_c,
  coalesce(sum(bought) filter (where arm = 1), 0) as x_t from {ARMS} {group}), p as (select *, x_c * 1.0 / n_c as p_c, x_t * 1.0 / n_t as p_t, (x_c + x_t) * 1.0 / (n_c + n_t) as pool from g
  where n_c >= 10 and n_t >= 10)
select {keys}n_c, n_t, cast(x_c as bigint) as x_c, cast(x_t as bigint) as x_t, {r('p_t - p_c', 6)} as difference, {r('case when p_c > 0 then 100 * (p_t - p_c) / p_c else 0 end')} as lift_pct,
  {r('(p_t - p_c) / case when pool > 0 and pool < 1 then sqrt(pool * (1 - pool) * (1.0 / n_c + 1.0 / n_t)) else 1e-5 end', 5)} as z,
  {r('abs(2 * asin(sqrt(p_t)) - 2 * asin(sqrt(p_c)))', 5)} as cohen_h, {r('case when p_c > 0 then p_t / p_c else 1 end', 5)} as relative_risk,
  {r('p_t - p_c - 1.959963984540054 * case when p_c > 0 or p_t > 0 then sqrt(p_c * (1 - p_c) / n_c + p_t * (1 - p_t) / n_t) else 1e-5 end', 5)} as ci_low from p"""


def conversion_run(segments):
    def run(spark, d):
        out = ex.conversion_test(arms(spark, d), "arm", 0, 1, "bought", segments)
        return out.select(*segments, "n_c", "n_t", "x_c", "x_t", rounded("difference", 6).alias("difference"), rounded("lift_pct").alias("lift_pct"), rounded("z", 5).alias("z"),
                          rounded("cohen_h", 5).alias("cohen_h"), rounded("relative_risk", 5).alias("relative_risk"), rounded("ci_low", 5).alias("ci_low"))
    return run


query("N1_conversion_test", _conversion(""))(conversion_run([]))
query("N1_conversion_test_per_day", _conversion("day"))(conversion_run(["day"]))


@query("N2_mean_test_per_type", f"""
with g as (select event_type, count(value) filter (where arm = 0) as n_c, count(value) filter (where arm = 1) as n_t, avg(value) filter (where arm = 0) as m_c, avg(value) filter (where arm = 1) as m_t,
  var_samp(value) filter (where arm = 0) as v_c, var_samp(value) filter (where arm = 1) as v_t from {ARMS} group by 1)
select event_type, n_c, n_t, {r('m_c')} as mean_c, {r('m_t')} as mean_t, {r('m_t - m_c')} as difference, {r('100 * (m_t - m_c) / m_c')} as lift_pct, {r('(m_t - m_c) / sqrt(v_c / n_c + v_t / n_t)')} as t,
  {r('pow(v_c / n_c + v_t / n_t, 2) / (pow(v_c / n_c, 2) / (n_c - 1) + pow(v_t / n_t, 2) / (n_t - 1))', 3)} as dof, {r('abs(m_t - m_c) / sqrt(((n_c - 1) * v_c + (n_t - 1) * v_t) / (n_c + n_t - 2))', 5)} as cohen_d from g""")
def mean_test(spark, d):
    out = ex.mean_test(arms(spark, d), "arm", 0, 1, "value", ["event_type"])
    return out.select("event_type", "n_c", "n_t", *[rounded(c).alias(c) for c in ("mean_c", "mean_t", "difference", "lift_pct", "t")],
                      rounded("dof", 3).alias("dof"), rounded("cohen_d", 5).alias("cohen_d"))


@query("N3_required_size", f"""
with b as (select event_type, avg(arm * 0.5) as rate from {ARMS} group by 1), e as (select *, least(0.9999, greatest(0.0001, rate * 1.2)) as x from b)
select event_type, {r('x', 6)} as expected, cast(ceil(2 * pow(1.959963984540054 + 0.8416212335729143, 2) * ((rate + x) / 2) * (1 - (rate + x) / 2) / pow(x - rate, 2)) as bigint) as n_per_arm from e""")
def required(spark, d):
    base = arms(spark, d).groupBy("event_type").agg(F.avg(F.col("arm") * 0.5).alias("rate"))
    return ex.required_size(base, "rate", 20).select("event_type", rounded("expected", 6).alias("expected"), "n_per_arm")


# ---- time series ------------------------------------------------------------------------------------

@query("O1_detect_columns", "select 'o_orderdate' as date, 'o_totalprice' as metric where (select count(*) > 0 from orders)")
def detect(spark, d):
    return spark.createDataFrame([ts.detect_columns(table(spark, d, "orders"))], "date string, metric string")


UNITS = {"D": ("day", "interval 1 day"), "W": ("week", "interval 7 day"), "M": ("month", "interval 1 month"), "Q": ("quarter", "interval 3 month"), "Y": ("year", "interval 1 year")}


def _resample(freq: str, agg: str, source: str, empty: str = "v") -> str:
    unit, step = UNITS[freq]
    return f"""(with p as (select cast(date_trunc('{unit}', o_orderdate) as timestamp) as period, {agg} as v from {source} group by 1),
  s as (select unnest(generate_series(min(period), max(period), {step})) as period from p) select s.period, {empty} as value from s left join p on s.period = p.period)"""


for _freq in UNITS:
    query(f"O2_O3_resample_{UNITS[_freq][0]}", f"select period, {r('value', 2)} as value from {_resample(_freq, 'sum(o_totalprice)', 'orders', 'coalesce(v, 0)')}")(
        lambda spark, d, f=_freq: show(ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", f), 2))


@query("O2_resample_mean_period_end", f"select cast(last_day(period) as timestamp) as period, {r('value')} as value from {_resample('M', 'avg(o_totalprice)', 'orders')}")
def resample_end(spark, d):
    return show(ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "M", "mean", label="end"))


def _gaps(freq: str, agg: str, shown: str = "s.period") -> str:
    """Periods, empty ones, ends and sum of values of each customer's series, over all orders."""
    unit, step = UNITS[freq]
    return f"""
with p as (select o_custkey, cast(date_trunc('{unit}', o_orderdate) as timestamp) as period, {agg} as v from orders group by 1, 2),
s as (select o_custkey, unnest(generate_series(min(period), max(period), {step})) as period from p group by 1)
select s.o_custkey, count(*) as periods, count(*) filter (where v is null) as empty, min(cast({shown} as timestamp)) as first, max(cast({shown} as timestamp)) as last, {r('sum(v)', 2)} as value
from s left join p on s.o_custkey = p.o_custkey and s.period = p.period group by 1"""


def gaps(series):
    # Sums show empty periods as 0, which no order costs; means show them as null.
    return series.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("periods"), F.count_if(F.coalesce("value", F.lit(0)) == 0).alias("empty"),
                                           F.min("period").alias("first"), F.max("period").alias("last"), rounded(F.sum("value"), 2).alias("value"))


# Sparse series of all orders: a customer has none in most periods.
for _freq in UNITS:
    query(f"O2_O3_resample_{UNITS[_freq][0]}_per_customer", _gaps(_freq, "sum(o_totalprice)"))(
        lambda spark, d, f=_freq: gaps(ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", f, by=["o_custkey"])))


@query("O2_resample_mean_period_end_per_customer", _gaps("M", "avg(o_totalprice)", "last_day(s.period)"))
def resample_end_per_customer(spark, d):
    return gaps(ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "M", "mean", ["o_custkey"], label="end"))


@query("O2_resample_many_series", f"""
with p as (select o_orderpriority, cast(date_trunc('month', o_orderdate) as timestamp) as period, count(*) as v from orders group by 1, 2),
s as (select o_orderpriority, unnest(generate_series(min(period), max(period), interval 1 month)) as period from p group by 1)
select s.o_orderpriority, s.period, cast(coalesce(v, 0) as bigint) as value from s left join p on s.period = p.period and s.o_orderpriority = p.o_orderpriority""")
def resample_many(spark, d):
    return ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "M", "count", ["o_orderpriority"])


MONTHLY = _resample("M", "sum(o_totalprice)", "orders", "coalesce(v, 0)")


@query("O4_growth", f"select period, {r('value', 2)} as value, {r('coalesce(100 * (value - lag(value) over (order by period)) / lag(value) over (order by period), 0)')} as growth_pct from {MONTHLY}")
def growth(spark, d):
    out = show(ts.growth(table(spark, d, "orders"), "o_orderdate", "o_totalprice"))
    return out.withColumn("value", rounded("value", 2))


@query("O4_growth_summary", f"""
with g as (select period, 100 * (value - lag(value) over (order by period)) / lag(value) over (order by period) as g from {MONTHLY})
select {r('max_by(g, period)')} as recent_growth_pct, {r('avg(g)')} as average_growth_pct,
  case when max_by(g, period) > 5 then 'Accelerating' when max_by(g, period) < -5 then 'Decelerating' else 'Stable' end as trend from g where g is not null""")
def growth_summary(spark, d):
    return show(ts.growth_summary(table(spark, d, "orders"), "o_orderdate", "o_totalprice"))


@query("O5_decompose", f"""
with t as (select period, value, avg(value) over (order by period rows between 2 preceding and 1 following) as trend from {MONTHLY})
select period, {r('value', 2)} as value, {r('trend', 3)} as trend, {r('value - trend', 3)} as residual from t""")
def decompose(spark, d):
    out = ts.decompose(ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice"))
    return out.select("period", rounded("value", 2).alias("value"), rounded("trend", 3).alias("trend"), rounded("residual", 3).alias("residual"))


SES = f"""
with recursive t as (select value, row_number() over (order by period) as i, count(*) over () as n, max(period) over () as last_period from {MONTHLY}),
k as (select *, cast(least(6, greatest(1, floor(n * 0.2))) as int) as test from t),
f as (select i, value as level, n, test, last_period from k where i = 1 union all
  select k.i, 0.3 * k.value + 0.7 * f.level, k.n, k.test, k.last_period from f join k on k.i = f.i + 1)"""


@query("O6_O9_smoothing_forecast", SES + f""",
e as (select sqrt(avg(pow(k.value - (select level from f where i = n - test), 2))) as rmse from k where i > n - test)
select cast(s as int) as step, cast(last_period + to_months(s::int) as timestamp) as period, {r('level', 2)} as forecast, {r('greatest(0, level - 1.28 * rmse)', 1)} as lower_80, {r('level + 1.96 * rmse', 1)} as upper_95
from f, e, (select unnest(range(1, 7)) as s) where i = n""")
def smoothing(spark, d):
    out = ts.forecast(ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice"), 6)
    return out.select("step", "period", rounded("forecast", 2).alias("forecast"), rounded("lower_80", 1).alias("lower_80"), rounded("upper_95", 1).alias("upper_95"))


@query("O8_backtest", SES + f""", a as (select abs(k.value - (select level from f where i = n - test)) as e, k.value as y, n, test from k where i > n - test)
select cast(max(n) as int) as periods, cast(max(test) as int) as test_periods, {r('avg(e)', 2)} as mae, {r('sqrt(avg(e * e))', 2)} as rmse, {r('100 * avg(e / abs(y + 1e-6))')} as mape_pct from a""")
def backtest(spark, d):
    out = ts.backtest(ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice"))
    return out.select("periods", "test_periods", rounded("mae", 2).alias("mae"), rounded("rmse", 2).alias("rmse"), rounded("mape_pct").alias("mape_pct"))


@query("O6_moving_average_many_series", f"""
with p as (select o_orderpriority, cast(date_trunc('quarter', o_orderdate) as timestamp) as period, sum(o_totalprice) as v from orders group by 1, 2),
k as (select *, row_number() over (partition by o_orderpriority order by period desc) as back from p)
select o_orderpriority, {r('avg(v)', 2)} as forecast from k where back <= 4 group by 1""")
def moving_average(spark, d):
    series = ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "Q", by=["o_orderpriority"])
    out = ts.forecast(series, 1, "Q", "moving_average", ["o_orderpriority"])
    return out.select("o_orderpriority", rounded("forecast", 2).alias("forecast"))


@query("O10_holt_winters")
def holt_winters(spark, d):
    series = ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "M", by=["o_orderstatus"])
    return ts.forecast(series, 12, "M", "holt_winters", ["o_orderstatus"])


@query("O7_boosted_forecast")
def boosted(spark, d):
    series = ts.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "M", by=["o_orderstatus"])
    return ts.forecast_boosted(series, 12, "M", ["o_orderstatus"])


# ---- business -----------------------------------------------------------------------------------------

STATUS = "case when p >= 105 then 'Exceeded Target' when p >= 95 then 'On Track' when p >= 80 then 'At Risk' else 'Lagging Behind Target' end"


@query("P1_goal_tracking", f"""
with t as (select sum(o_totalprice) as a, round(100 * sum(o_totalprice) / 4e9, 1) as p from orders)
select {r('a', 2)} as actual, cast(4e9 as double) as target, {r('a - 4e9', 2)} as variance, {r('100 * a / 4e9')} as pct_achieved, {STATUS} as status from t""")
def goal(spark, d):
    out = show(bs.goal_tracking(table(spark, d, "orders"), "o_totalprice", 4e9), 2)
    return out.withColumn("pct_achieved", bs.goal_tracking(table(spark, d, "orders"), "o_totalprice", 4e9).select(rounded("pct_achieved")).scalar())


@query("P1_goal_segments", f"""
with t as (select o_orderpriority as segment, sum(o_totalprice) as a, 4e9 / count(*) over () as t from orders group by 1)
select segment, {r('a', 2)} as actual, cast(t as double) as target, {r('a - t', 2)} as variance, {r('100 * a / t', 2)} as pct_achieved from t""")
def goal_segments(spark, d):
    return show(bs.goal_segments(table(spark, d, "orders"), "o_totalprice", 4e9, "o_orderpriority"), 2)


@query("P2_insights", f"""
with t as (select p_type as segment, sum(p_retailprice) as v from part group by 1),
q as (select quantile_cont(p_retailprice, 0.25) a, quantile_cont(p_retailprice, 0.75) b from part)
select 'top_driver' as kind, max_by(segment, v) as subject, {r('100 * max(v) / sum(v)')} as value from t""")
def insights(spark, d):
    return show(bs.insights(table(spark, d, "part"), "p_type", "p_retailprice").where("kind = 'top_driver'").drop("detail"))


@query("P2_extreme_values", f"""
with t as (select exp(l_quantity / 8) as v from lineitem), q as (select quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b from t)
select 'extreme_values' as kind, 'tail' as subject, cast(count(*) as double) as value from t, q where v > b + 3 * (b - a) or v < a - 3 * (b - a) having count(*) > 0""")
def extremes(spark, d):
    t = table(spark, d, "lineitem").select(F.exp(F.col("l_quantity") / 8).alias("tail"))
    return bs.insights(t).where("kind = 'extreme_values'").drop("detail")


@query("P3_kpi_export", f"""
with k as (select o_totalprice as v, row_number() over (order by o_orderdate, o_orderkey) as i, count(*) over () as n from orders),
s as (select sum(v) as total, avg(v) as average, avg(v) filter (where i <= n // 2) as a, avg(v) filter (where i > n // 2) as b from k)
select 'o_totalprice' as metric, {r('total', 2)} as total, {r('average', 3)} as average, {r('100 * (b - a) / abs(a)')} as growth_pct, case when b >= a then 'Positive' else 'Decline' end as status from s""")
def kpi_export(spark, d):
    out = bs.kpi_export(table(spark, d, "orders"), ["o_totalprice"], ["o_orderdate", "o_orderkey"])
    return out.select("metric", rounded("total", 2).alias("total"), rounded("average", 3).alias("average"), rounded("growth_pct").alias("growth_pct"), "status")


@query("P3_kpi_segments", f"""
select p_brand as segment, {r('sum(p_retailprice)', 2)} as total, {r('100 * sum(p_retailprice) / (select sum(p_retailprice) from part)')} as share_pct from part group by 1 order by sum(p_retailprice) desc, 1 limit 8""")
def kpi_segments(spark, d):
    out = show(bs.kpi_segments(table(spark, d, "part"), "p_brand", "p_retailprice"))
    return out.withColumn("total", rounded("total", 2))


@query("P3_kpi_anomalies", f"""
with t as (select exp(l_quantity / 8) as v from lineitem), q as (select quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b from t)
select 'tail' as metric, cast(count(*) as bigint) as anomalies from t, q where v > b + 2.5 * (b - a) or v < a - 2.5 * (b - a) having count(*) > 0""")
def kpi_anomalies(spark, d):
    return bs.kpi_anomalies(table(spark, d, "lineitem").select(F.exp(F.col("l_quantity") / 8).alias("tail")), ["tail"])


@query("P4_dashboard", f"""
select 'bars' as part, o_orderpriority as name, {r('sum(o_totalprice)', 2)} as value from orders group by 2 union all
select 'trend', strftime(period, '%Y-%m-%d'), {r('value', 2)} from {MONTHLY} union all
select 'kpis', 'mean', {r('avg(o_totalprice)', 2)} from orders""")
def dashboard(spark, d):
    parts = bs.dashboard(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", "o_orderdate")
    out = parts["bars"].select(F.lit("bars").alias("part"), F.col("segment").alias("name"), F.col("total").alias("value"))
    out = out.union(parts["trend"].select(F.lit("trend"), F.date_format("period", "yyyy-MM-dd"), "value"))
    return show(out.union(parts["kpis"].select(F.lit("kpis"), F.lit("mean"), "mean")), 2)


@query("P5_top_segments", f"""select p_brand as segment, {r('sum(p_retailprice)', 2)} as total, cast(count(*) as bigint) as n from part group by 1 order by sum(p_retailprice) desc, 1 limit 5""")
def top_segments(spark, d):
    return show(bs.top_segments(table(spark, d, "part"), "p_brand", "p_retailprice", 5), 2)


@query("P5_avg_by", f"select c_mktsegment as segment, {r('avg(c_acctbal)')} as average, cast(count(*) as bigint) as n from customer group by 1")
def avg_by(spark, d):
    return show(bs.avg_by(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


@query("P5_O11_monthly_trend", f"""select cast(date_trunc('month', o_orderdate) as timestamp) as month, cast(count(*) as bigint) as n, {r('avg(o_totalprice)', 3)} as average,
  {r('sum(o_totalprice)', 2)} as total from orders group by 1""")
def monthly_trend(spark, d):
    out = bs.monthly_trend(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return out.select("month", "n", rounded("average", 3).alias("average"), rounded("total", 2).alias("total"))


@query("P5_segment_summary", f"""select o_orderstatus as segment, cast(count(*) as bigint) as n, {r('sum(o_totalprice)', 2)} as total, {r('avg(o_totalprice)', 3)} as average, min(o_totalprice) as min, max(o_totalprice) as max
from orders group by 1""")
def segment_summary(spark, d):
    out = bs.segment_summary(table(spark, d, "orders"), "o_orderstatus", "o_totalprice")
    return out.select("segment", "n", rounded("total", 2).alias("total"), rounded("average", 3).alias("average"), "min", "max")


# Ready-made questions to a table, in SQL: how values spread, which rows stand out, how a share moves.
SPREAD = """select o_orderstatus, {count} as orders, {spread} as price_range, {middle} as middle_price from {source} where o_totalprice is not null group by o_orderstatus"""


@query("P6_template_aggregation", SPREAD.format(source="orders", count="cast(count(*) as bigint)", spread=r("max(o_totalprice) - min(o_totalprice)", 2), middle=r("median(o_totalprice)", 2)))
def template_spread(spark, d):
    return query_table(table(spark, d, "orders"), SPREAD.format(
        source="df", count="count(*)", spread="round(max(o_totalprice) - min(o_totalprice) + 3e-7, 2)", middle="round(percentile(o_totalprice, 0.5) + 3e-7, 2)"))


# Orders over twice what their customer pays on average, in two steps.
STANDING_OUT = """with usual as (select o_custkey as who, avg(o_totalprice) as pays from {source} group by o_custkey)
  select o_orderkey, o_custkey, round(o_totalprice / pays + 3e-7, 3) as times_usual from {source} join usual on who = o_custkey where o_totalprice > 2 * pays"""


@query("P6_template_filter_in_steps", STANDING_OUT.format(source="orders"))
def template_standing_out(spark, d):
    return query_table(table(spark, d, "orders"), STANDING_OUT.format(source="df"))


# The share of urgent orders by year, and its change on the year before.
URGENT = """with yearly as (select extract(year from o_orderdate) as y, avg(if(o_orderpriority = '1-URGENT', 1e0, 0e0)) as urgent from {source} group by 1)
  select cast(y as bigint) as year, round(100 * urgent + 3e-7, 2) as urgent_percent, round(100 * (urgent - lag(urgent) over (order by y)) + 3e-7, 2) as change from yearly"""


@query("P6_template_rate_by_segment", URGENT.format(source="orders"))
def template_urgent(spark, d):
    return query_table(table(spark, d, "orders"), URGENT.format(source="df"))


@query("P8_signals", f"""
with t as (select exp(l_quantity / 8) as tail from lineitem)
select 'skew' as kind, 'tail' as subject, {r('skewness(tail)')} as value from t union all
select 'widest_spread', 'tail', {r('stddev_samp(tail)')} from t union all
select 'dominant_value', 'mark', {r("100.0 * count(*) filter (where l_quantity > 5) / count(*)")} from lineitem""")
def signals(spark, d):
    t = table(spark, d, "lineitem").select(F.exp(F.col("l_quantity") / 8).alias("tail"), F.when(F.col("l_quantity") > 5, "many").otherwise("few").alias("mark"))
    return show(bs.signals(t).where("kind in ('skew', 'widest_spread', 'dominant_value')").drop("detail"))
