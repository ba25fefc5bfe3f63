"""Scaling, binning, encoding, date, text and automatic features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import features as ft, scaling as sc
from lumenframe.plans.registry import query, r, rounded, show, table
from lumenframe.plans.windows import KEYS, ORDER, PRICED, priced

# Account balances with gaps.
BAL = "(select c_custkey, c_mktsegment, c_nationkey, case when c_custkey % 11 = 0 then null else c_acctbal end as bal from customer)"


def balances(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey",
                                              F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")).alias("bal"))


FILLED = f"(select c_custkey, coalesce(bal, (select median(bal) from {BAL})) as v from {BAL})"
SCALES = {"standard": ("std", f"(v - (select avg(v) from {FILLED})) / (select stddev_pop(v) from {FILLED})"),
          "minmax": ("minmax", f"(v - (select min(v) from {FILLED})) / (select max(v) - min(v) from {FILLED})"),
          "robust": ("robust", f"(v - (select median(v) from {FILLED})) / (select quantile_cont(v, 0.75) - quantile_cont(v, 0.25) from {FILLED})")}
for _method, (_suffix, _sql) in SCALES.items():
    query(f"M1_scale_{_method}", f"select c_custkey, {r(_sql)} as scaled from {FILLED}")(
        lambda spark, d, m=_method, s=_suffix: sc.scale_features(balances(spark, d), ["bal"], m, decimals=None).select(
            "c_custkey", rounded(f"bal_{s}").alias("scaled")))


@query("M3_bin_quantile", f"""
with e as (select quantile_cont(bal, [0, 0.25, 0.5, 0.75, 1]) as e from {BAL})
select c_custkey, case when bal <= e[2] then 'Bin_1' when bal <= e[3] then 'Bin_2' when bal <= e[4] then 'Bin_3' when bal <= e[5] then 'Bin_4' end as bin from {BAL}, e""")
def bin_quantile(spark, d):
    return sc.bin_feature(balances(spark, d), "bal", 4, "quantile", "bin").select("c_custkey", "bin")


@query("M3_bin_uniform", f"""
with e as (select min(bal) as lo, (max(bal) - min(bal)) / 4 as w from {BAL})
select c_custkey, case when bal <= lo + w then 'Bin_1' when bal <= lo + 2 * w then 'Bin_2' when bal <= lo + 3 * w then 'Bin_3' when bal is not null then 'Bin_4' end as bin from {BAL}, e""")
def bin_uniform(spark, d):
    return sc.bin_feature(balances(spark, d), "bal", 4, "uniform", "bin").select("c_custkey", "bin")


@query("M4_bin_custom", f"""
select c_custkey, case when bal < -500 then null when bal <= 0 then '(-500.001, 0.0]' when bal <= 1000 then '(0.0, 1000.0]' when bal <= 2500.5 then '(1000.0, 2500.5]' end as bin from {BAL}""")
def bin_custom(spark, d):
    return sc.bin_column(balances(spark, d), "bal", "custom", custom_edges=[-500, 0, 1000, 2500.5], name="bin").select("c_custkey", "bin")


@query("M4_bin_equal_width", f"""
with e as (select min(bal) as lo, max(bal) as hi from {BAL})
select c_custkey, case when bal <= lo + (hi - lo) / 3 then 'low' when bal <= lo + 2 * (hi - lo) / 3 then 'mid' when bal is not null then 'high' end as bin from {BAL}, e""")
def bin_width(spark, d):
    return sc.bin_column(balances(spark, d), "bal", "equal_width", 3, ["low", "mid", "high"], name="bin").select("c_custkey", "bin")


@query("M5_one_hot", """
with top as (select p_brand from part group by 1 order by count(*) desc, 1 limit 3)
select p_partkey, (p_type = 'ECONOMY')::int as p_type_ECONOMY, (p_type = 'SMALL')::int as p_type_SMALL, (p_brand not in (from top))::int as p_brand_Other from part""")
def one_hot(spark, d):
    t = table(spark, d, "part")
    out = ft.one_hot(ft.one_hot(t, ["p_type"]), ["p_brand"], 3)
    return out.select("p_partkey", "p_type_ECONOMY", "p_type_SMALL", "p_brand_Other")


@query("M6_label_encode", """
select p_partkey, cast(case when p_size % 7 = 0 then null else (select count(distinct p_brand) from part b where b.p_size % 7 <> 0 and b.p_brand < a.p_brand) end as double) as code from part a""")
def label_encode(spark, d):
    t = table(spark, d, "part").withColumn("p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")))
    return ft.label_encode(t, "p_brand", "code").select("p_partkey", "code")


@query("M7_D7_frequency_encode", f"""
select p_partkey, {r("case when p_size % 7 <> 0 then count(*) filter (where p_size % 7 <> 0) over (partition by p_brand) * 1.0 / (select count(*) from part where p_size % 7 <> 0) end", 6)} as freq from part""")
def frequency_encode(spark, d):
    t = table(spark, d, "part").withColumn("p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")))
    return show(ft.frequency_encode(t, "p_brand", "freq", None).select("p_partkey", "freq"), 6)


@query("M8_target_encode", f"""
with g as (select c_nationkey, count(bal) as n, avg(bal) as m from {BAL} group by 1), o as (select avg(bal) as m from {BAL})
select c_custkey, {r('coalesce((g.n * g.m + 10 * o.m) / (g.n + 10), o.m)')} as enc from {BAL} t join g using (c_nationkey), o""")
def target_encode(spark, d):
    return show(ft.target_encode(balances(spark, d), "c_nationkey", "bal", 10.0, "enc", None).select("c_custkey", "enc"))


@query("M9_encode_for_models", f"""
select p_partkey, (p_type = 'SMALL')::double as p_type_SMALL, {r('count(*) over (partition by p_brand) * 1.0 / (select count(*) from part)', 6)} as p_brand_freq_enc from part""")
def encode_models(spark, d):
    out = ft.encode_for_models(table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), "p_partkey")
    return out.select("p_partkey", "p_type_SMALL", rounded("p_brand_freq_enc", 6).alias("p_brand_freq_enc"))


@query("M10_date_features", """
select event_id, cast(year(ts) as int) as ts_year, cast(month(ts) as int) as ts_month, cast(day(ts) as int) as ts_day, cast(isodow(ts) - 1 as int) as ts_dayofweek,
  (isodow(ts) >= 6)::int as ts_is_weekend, cast(quarter(ts) as int) as ts_quarter, case when month(ts) in (12, 1, 2) then 'Winter' when month(ts) <= 5 then 'Spring'
  when month(ts) <= 8 then 'Summer' else 'Fall' end as ts_season, cast(hour(ts) as int) as ts_hour from events""")
def date_features(spark, d):
    return ft.date_features(table(spark, d, "events").select("event_id", "ts"), ["ts"], drop_original=True)


@query("M11_interaction", f"""
select l_orderkey, l_linenumber, {r('case when l_discount = 0 then null else l_tax / l_discount end')} as ratio, {r('l_quantity * l_discount')} as product from lineitem""")
def interaction(spark, d):
    t = ft.interaction(table(spark, d, "lineitem"), "l_tax", "l_discount", "ratio", "ratio", None)
    return show(ft.interaction(t, "l_quantity", "l_discount", "product", "product", None).select("l_orderkey", "l_linenumber", "ratio", "product"))


@query("M12_polynomial_features", f"""
with m as (select avg(bal) as m from {BAL})
select c_custkey, {r('coalesce(bal, m) * coalesce(bal, m)', 1)} as bal_pow_2, {r('coalesce(bal, m) * c_nationkey', 2)} as bal_c_nationkey, cast(c_nationkey * c_nationkey as double) as c_nationkey_pow_2 from {BAL}, m""")
def polynomial(spark, d):
    out = ft.polynomial_features(balances(spark, d), ["bal", "c_nationkey"], 2)
    return out.select("c_custkey", rounded("bal_pow_2", 1).alias("bal_pow_2"), rounded("bal_c_nationkey", 2).alias("bal_c_nationkey"), "c_nationkey_pow_2")


@query("M13_rolling_features", f"""
with f as (select *, last_value(price ignore nulls) over ({ORDER} rows unbounded preceding) as p from {PRICED})
select o_orderkey, {r(f'avg(price) over ({ORDER} rows 4 preceding)', 3)} as price_roll_mean_5, {r(f'coalesce(stddev_samp(price) over ({ORDER} rows 4 preceding), 0)', 3)} as price_roll_std_5,
  {r(f'coalesce(100 * (p / lag(p) over ({ORDER}) - 1), 0)', 3)} as price_pct_change from f""")
def rolling(spark, d):
    out = ft.rolling_features(priced(spark, d), "price", 5, KEYS, operations=("mean", "std", "pct_change"))
    return show(out.select("o_orderkey", "price_roll_mean_5", "price_roll_std_5", "price_pct_change"), 3)


POSITIVE = ", ".join(f"'{w}'" for w in ft.POSITIVE_WORDS)
NEGATIVE = ", ".join(f"'{w}'" for w in ft.NEGATIVE_WORDS)


@query("M14_text_features", f"""
with w as (select doc_id, text, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+')) as words from documents),
s as (select *, len(list_intersect(words, [{POSITIVE}])) as p, len(list_intersect(words, [{NEGATIVE}])) as n from w)
select doc_id, cast(length(text) as int) as text_char_count, cast(len(regexp_extract_all(text, '[^\\s\\x0b\\x85\\x{{a0}}\\p{{Z}}]+')) as int) as text_word_count,
  cast(len(regexp_extract_all(text, '\\p{{Nd}}')) as int) as text_digits_count, round(case when p + n = 0 then 0.0 else (p - n) * 1.0 / (p + n) end + 3e-7, 2) as text_sentiment_score from s""")
def text_features(spark, d):
    out = ft.text_features(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")
    return show(out, 2)


@query("M15_recommendations", """
select 'tail' as "column", 'log_transform' as type where (select skewness(exp(l_quantity / 10)) > 1.2 from lineitem) union all select 'l_shipdate', 'date_parts' union all
select 'l_returnflag', 'one_hot' union all select 'revenue & cost', 'difference'""")
def recommendations(spark, d):
    t = table(spark, d, "lineitem").select(F.exp(F.col("l_quantity") / 10).alias("tail"), "l_shipdate", "l_returnflag",
                                           F.col("l_extendedprice").alias("revenue"), F.col("l_discount").alias("cost"))
    return ft.recommendations(t).select("column", "type")


@query("M16_auto_features", f"""
with s as (select avg(l_quantity) as m, stddev_pop(l_quantity) as sd from lineitem)
select l_orderkey, l_quantity, l_returnflag, cast(year(l_shipdate) as int) as l_shipdate_year, (l_returnflag = 'A')::int as l_returnflag_A,
  round((l_quantity - m) / sd, 4) as l_quantity_std from lineitem, s""")
def auto_features(spark, d):
    out = ft.auto_features(table(spark, d, "lineitem").select("l_quantity", "l_shipdate", "l_returnflag", "l_orderkey"))
    return out.select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate_year", "l_returnflag_A", "l_quantity_std")


@query("M17_model_features", f"""
select l_orderkey, cast(month(l_shipdate) as double) as l_shipdate_month, {r('ln(1 + exp(l_quantity / 10))')} as tail_log1p, {r('exp(l_quantity / 10) / (abs(l_discount) + 1e-5)', 2)} as tail_div_l_discount from lineitem""")
def model_features(spark, d):
    t = table(spark, d, "lineitem").select(F.exp(F.col("l_quantity") / 10).alias("tail"), "l_discount", "l_shipdate", "l_orderkey")
    out = ft.model_features(t, "l_orderkey")
    return out.select("l_orderkey", "l_shipdate_month", rounded("tail_log1p").alias("tail_log1p"), rounded("tail_div_l_discount", 2).alias("tail_div_l_discount"))
