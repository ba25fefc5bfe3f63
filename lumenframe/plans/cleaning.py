"""Imputation, outliers, text clean-up, profiles, quality rules, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lumenframe.operators import cleaning as cl, profile as pf, quality as ql, summaries as sm
from lumenframe.plans.registry import query, r, rounded, show, table
from lumenframe.streaming.sinks import new_folder

# Order lines with gaps in three columns and some repeated rows.
DIRTY = """(select l_suppkey, l_linenumber, case when l_orderkey % 17 = 0 then null else l_quantity end as quantity,
  case when l_orderkey % 13 = 0 then null else l_extendedprice end as price,
  case when l_orderkey % 19 = 0 then null else l_returnflag end as flag from lineitem)"""


def dirty(spark, d):
    t, key = table(spark, d, "lineitem"), F.col("l_orderkey")
    return t.select("l_suppkey", "l_linenumber", F.when(key % 17 != 0, F.col("l_quantity")).alias("quantity"),
                    F.when(key % 13 != 0, F.col("l_extendedprice")).alias("price"),
                    F.when(key % 19 != 0, F.col("l_returnflag")).alias("flag"))


@query("J1_J7_impute", f"""
with s as (select avg(price) as m, median(quantity) as q from {DIRTY}),
f as (select flag as mode from {DIRTY} where flag is not null group by flag order by count(*) desc, flag limit 1)
select l_suppkey, l_linenumber, coalesce(quantity, q) as quantity, {r('coalesce(price, m)', 2)} as price, coalesce(flag, mode) as flag from {DIRTY}, s, f""")
def impute(spark, d):
    out, _ = cl.impute(dirty(spark, d), {"price": "mean", "quantity": "median", "flag": "mode"})
    return show(out, 2)


@query("J6_J7_constant_and_drop", f"""
select l_suppkey, coalesce(quantity, -1) as quantity, flag from {DIRTY} where flag is not null""")
def constant_drop(spark, d):
    out, _ = cl.impute(dirty(spark, d), {"quantity": "constant", "flag": "drop_row", "price": "drop_col"}, {"quantity": -1})
    return out.select("l_suppkey", "quantity", "flag")


@query("J8_impute_recommended", f"""
with s as (select median(quantity) as q, median(price) as p from {DIRTY}),
f as (select flag as mode from {DIRTY} where flag is not null group by flag order by count(*) desc, flag limit 1)
select l_suppkey, l_linenumber, coalesce(quantity, q) as quantity, {r('coalesce(price, p)', 3)} as price, coalesce(flag, mode) as flag from {DIRTY}, s, f""")
def impute_recommended(spark, d):
    return show(cl.impute(dirty(spark, d))[0], 3)


@query("J1_changelog", f"""
select 'impute' as step, 'quantity' as "column", cast(count(*) - count(quantity) as bigint) as affected from {DIRTY}
union all select 'impute', 'flag', cast(count(*) - count(flag) as bigint) from {DIRTY}""")
def changelog(spark, d):
    return cl.impute(dirty(spark, d), {"quantity": "median", "flag": "mode"})[1].select("step", "column", "affected")


# Cubed prices: a long upper tail.
PRICES = "(select l_orderkey, l_linenumber, pow(l_extendedprice / 1000, 3) as price from lineitem)"
BOUNDS = {
    "iqr": f"""(select quantile_cont(price, 0.25) - 0.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) as lo,
      quantile_cont(price, 0.75) + 0.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) as hi from {PRICES})""",
    "z_score": f"(select avg(price) - 1.5 * stddev_samp(price) as lo, avg(price) + 1.5 * stddev_samp(price) as hi from {PRICES})",
    "modified_z_score": f"""(select m - 3.5 * mad / 0.6745 as lo, m + 3.5 * mad / 0.6745 as hi from
      (select median(price) as m, mad(price) as mad from {PRICES}))""",
}
CHANGES = {"cap": ("least(greatest(price, lo), hi)", "true"), "set_nan": ("case when price between lo and hi then price end", "true"),
           "remove": ("price", "price between lo and hi")}
for _method, _bounds in BOUNDS.items():
    for _action, (_value, _where) in CHANGES.items():
        query(f"J10_J16_outliers_{_method}_{_action}",
              f"select l_orderkey, l_linenumber, {r(_value, 3)} as price from {PRICES}, {_bounds} where {_where}")(
            lambda spark, d, m=_method, a=_action: show(cl.handle_outliers(
                table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "pow(l_extendedprice / 1000, 3) as price"),
                ["price"], m, a, factor=0.5, z=1.5)[0], 3))


@query("J17_standardize_text", """
select distinct p_brand, upper(trim(p_name)) as p_name from (select upper(p_brand) as p_brand, '  ' || p_name || ' ' as p_name from part)""")
def standardize(spark, d):
    t = table(spark, d, "part").select("p_brand", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"))
    return cl.standardize_text(t, case="upper")


@query("J18_auto_clean", f"""
with t as (select distinct trim(flag) as flag, quantity, price, l_linenumber from (select flag, quantity, price, l_linenumber from {DIRTY})),
s as (select median(quantity) as q, median(price) as p from t),
f as (select flag as mode from t where flag is not null group by flag order by count(*) desc, flag limit 1),
i as (select coalesce(flag, mode) as flag, coalesce(quantity, q) as quantity, coalesce(price, p) as price, l_linenumber from t, s, f),
b as (select quantile_cont(price, 0.25) as pa, quantile_cont(price, 0.75) as pb, quantile_cont(quantity, 0.25) as qa, quantile_cont(quantity, 0.75) as qb from i)
select flag, l_linenumber, least(greatest(quantity, qa - 2.5 * (qb - qa)), qb + 2.5 * (qb - qa)) as quantity,
  {r('least(greatest(price, pa - 2.5 * (pb - pa)), pb + 2.5 * (pb - pa))', 3)} as price from i, b""")
def auto_clean(spark, d):
    t = dirty(spark, d).select("flag", "quantity", "price", "l_linenumber").withColumn("same", F.lit("x"))
    return show(cl.auto_clean(t)[0], 3)


@query("J19_J20_clean_for_models", f"""
with t as (select trim(flag) as flag, quantity, price, l_suppkey from {DIRTY} where price is not null),
s as (select median(quantity) as q from t), f as (select flag as mode from t where flag is not null group by flag order by count(*) desc, flag limit 1)
select coalesce(flag, mode) as flag, coalesce(quantity, q) as quantity, price, l_suppkey from t, s, f""")
def clean_models(spark, d):
    return cl.impute_for_models(cl.clean_for_models(dirty(spark, d), "price", ["l_linenumber"]), "price")


@query("J20_missing_flag", f"""
with s as (select median(w) as m from (select case when l_orderkey % 5 = 0 then null else l_tax end as w from lineitem))
select l_orderkey, coalesce(case when l_orderkey % 5 = 0 then null else l_tax end, m) as tax,
  cast(case when l_orderkey % 5 = 0 then 1 else 0 end as double) as tax_was_missing from lineitem, s""")
def missing_flag(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")).alias("tax"))
    return cl.impute_for_models(t, "l_orderkey")


@query("J21_step_log", f"""
with a as (select * from {DIRTY} where flag is not null), b as (select distinct * from a)
select 1 as position, 'known flag' as step, (select count(*) from {DIRTY}) as rows_in, (select count(*) from a) as rows_out
union all select 2, 'dedup', (select count(*) from a), (select count(*) from b)""")
def step_log(spark, d):
    steps = cl.Steps([("known flag", lambda t: t.dropna(subset=["flag"])), ("dedup", lambda t: t.distinct()), ("none", lambda t: t)])
    return steps.undo().run(dirty(spark, d))[1]


# ---- profiles -----------------------------------------------------------------------------------

def _stats(table_name: str, column: str, role: str, category: bool = False) -> str:
    number = role in ("numeric", "id") or column in ("l_linenumber", "l_discount")
    known = f"(select {column} as v from {table_name})"
    nums = ", ".join(f"{r(x)} as {n}" for x, n in (
        ("min(v)", "min"), ("max(v)", "max"), ("avg(v)", "mean"), ("median(v)", "median"), ("stddev_samp(v)", "std"),
        ("quantile_cont(v, 0.25)", "q25"), ("quantile_cont(v, 0.75)", "q75"))) if number else ", ".join(
        f"cast(null as double) as {n}" for n in ("min", "max", "mean", "median", "std", "q25", "q75"))
    out = (f"""(select count(*) from {known}, (select quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b from {known})
      where v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a))""" if number else "cast(null as bigint)")
    top = f"(select v from {known} where v is not null group by v order by count(*) desc, v limit 1)" if category else "null"
    freq = f"(select count(*) from {known} where v is not null group by v order by count(*) desc, v limit 1)" if category else "null"
    return f"""select '{column}' as "column", '{role}' as role, cast(count(*) - count(v) as bigint) as null_count,
      cast(count(distinct v) as bigint) as unique_count, {nums}, cast({out} as bigint) as outlier_count,
      cast({top} as varchar) as top_category, cast({freq} as bigint) as top_category_freq from {known}"""


@query("K1_K2_profile", " union all ".join([
    _stats("lineitem", "l_orderkey", "numeric"), _stats("lineitem", "l_linenumber", "categorical"), _stats("lineitem", "l_extendedprice", "numeric"),
    _stats("lineitem", "l_discount", "categorical"), _stats("lineitem", "l_returnflag", "categorical", True), _stats("lineitem", "l_shipdate", "datetime")]))
def profile(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    return show(pf.profile(t).drop("dtype", "null_pct", "unique_pct", "is_target_candidate"))


KEPT = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]


def _summary(column: str) -> str:
    number = column not in ("l_returnflag", "l_shipdate")
    v = f"cast({column} as double)" if number else "cast(null as double)"
    return f"""select '{column}' as "column", cast(count(*) as bigint) as rows, cast(count(*) - count({column}) as bigint) as missing, {r(f'avg({v})', 2)} as mean, {r(f'stddev_samp({v})', 2)} as std,
      min({v}) as min, max({v}) as max, cast(count(distinct {column}) as bigint) as distinct_exact, true as distinct_near, {'true' if number else 'cast(null as boolean)'} as quartiles_near from lineitem"""


@query("K1_E6_E7_merged_daily_summaries", " union all ".join(map(_summary, KEPT)))
def merged_summaries(spark, d):
    """Summaries of single ship dates, kept in a table and merged; estimates are held against the exact figures."""
    t = table(spark, d, "lineitem").select(*KEPT, F.col("l_shipdate").alias("day"))
    path = new_folder(spark, "summaries")
    sm.keep(sm.summarise(t, KEPT, "day"), path, "yyyy")
    found = sm.read_out(sm.merge(sm.kept(spark, path)))
    estimate = {r["column"]: r for r in found.collect()}    # one row for each column
    # Each column is folded to its values by itself: distinct counts of seven columns in one aggregate copy every row eight times.
    def exact(c):
        values = t.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        upto = [F.coalesce(F.sum(F.when(test(estimate[c][q]), F.col("n"))), F.lit(0)) if estimate[c][q] is not None else F.lit(None).cast("long")
                for test in (lambda e: F.col("v") < F.lit(e), lambda e: F.col("v") <= F.lit(e)) for q in ("q25", "q50", "q75")]
        return values.agg(F.array(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), *upto).alias("x")).select(F.lit(c).alias("column"), "x")

    long = reduce(DataFrame.union, map(exact, KEPT))
    near = F.lit(True)
    for i, q in enumerate((0.25, 0.5, 0.75)):
        near = near & (F.col("x")[2 + i] <= (q + sm.RANK_ERROR) * F.col("x")[1]) & (F.col("x")[5 + i] >= (q - sm.RANK_ERROR) * F.col("x")[1])
    out = found.join(long, "column").select(
        "column", "rows", "missing", rounded("mean", 2).alias("mean"), rounded("std", 2).alias("std"), "min", "max", F.col("x")[0].alias("distinct_exact"),
        (F.abs(F.col("distinct") - F.col("x")[0]) <= sm.DISTINCT_ERROR * F.col("x")[0]).alias("distinct_near"), near.alias("quartiles_near"))
    return out


@query("K3_feature_categories", """select 'numerical' as category, unnest(['l_linenumber', 'l_quantity']) as "column"
union all select 'categorical_low', unnest(['l_returnflag', 'l_linestatus']) union all select 'datetime', 'l_shipdate' from lineitem where false
union all select 'datetime', 'l_shipdate'""")
def categories(spark, d):
    t = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    return pf.as_table(t, pf.feature_categories(t))


@query("K4_automl_types", """select unnest(['boolean', 'categorical_low', 'categorical_high', 'datetime', 'id_or_constant', 'numeric_continuous', 'numeric_discrete']) as category,
  unnest(['toxic', 'p_type', 'p_brand', 'day', 'p_partkey', 'p_retailprice', 'p_small']) as "column" """)
def automl_types(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice", (F.col("p_size") % 5).alias("p_small"),
                                       (F.col("p_partkey") % 2).alias("toxic"), F.timestamp_seconds(F.col("p_partkey") % 100 * 86400).alias("day"),
                                       F.col("p_size").alias("target"))
    return pf.as_table(t, pf.automl_types(t, "target"))


COUNTS = f"""(select count(*) as n, sum((quantity is null)::int + (price is null)::int + (flag is null)::int) as missing from {DIRTY}),
  (select count(*) as kept from (select distinct * from {DIRTY}))"""


@query("K5_health_score", f"""
with q as (select *, quantile_cont(quantity, 0.25) over () a1, quantile_cont(quantity, 0.75) over () b1, quantile_cont(price, 0.25) over () a2,
  quantile_cont(price, 0.75) over () b2 from {DIRTY}),
o as (select count(*) filter (where quantity < a1 - 2.5 * (b1 - a1) or quantity > b1 + 2.5 * (b1 - a1)) +
  count(*) filter (where price < a2 - 2.5 * (b2 - a2) or price > b2 + 2.5 * (b2 - a2)) as outliers from q),
c as (select *, round(100.0 * missing / (n * 5), 2) as mp, round(100.0 * (n - kept) / n, 2) as dp from {COUNTS}, o)
select cast(round(100 - least(35, mp * 1.5) - least(20, dp * 2)) as int) as health_score, cast(missing as bigint) as missing_cells,
  cast(n - kept as bigint) as duplicated_rows, cast(outliers as bigint) as outlier_cells from c""")
def health(spark, d):
    return pf.health_score(dirty(spark, d)).select("health_score", "missing_cells", "duplicated_rows", "outlier_cells")


@query("K6_audit_summary", f"""
with q as (select quantile_cont(quantity, 0.25) a1, quantile_cont(quantity, 0.75) b1, quantile_cont(price, 0.25) a2, quantile_cont(price, 0.75) b2 from {DIRTY}),
o as (select count(*) filter (where quantity < a1 - 1.5 * (b1 - a1) or quantity > b1 + 1.5 * (b1 - a1)) +
  count(*) filter (where price < a2 - 1.5 * (b2 - a2) or price > b2 + 1.5 * (b2 - a2)) as outliers from {DIRTY}, q),
c as (select *, round(100.0 * (n - kept) / n, 2) as dp from {COUNTS}, o)
select cast(n as bigint) as rows, cast(missing as bigint) as missing_cells, cast(n - kept as bigint) as duplicate_rows,
  cast(greatest(5, round(100 - least(40, 150.0 * missing / (n * 5)) - least(25, dp * 2.5) - least(15, 100.0 * outliers / (n * 4)))) as int) as quality_score from c""")
def audit(spark, d):
    return pf.audit_quality(dirty(spark, d))["summary"].select("rows", "missing_cells", "duplicate_rows", "quality_score")


@query("K6_outlier_table", f"""
with v as (select exp(o_totalprice / 50000) as v from orders), q as (select quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b, avg(v) m, stddev_samp(v) s from v)
select 'tail' as "column", cast(count(*) filter (where v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a)) as bigint) as iqr_outliers,
  cast(count(*) filter (where abs(v - m) > 3 * s) as bigint) as z_score_outliers from v, q""")
def outlier_table(spark, d):
    t = table(spark, d, "orders").select(F.exp(F.col("o_totalprice") / 50000).alias("tail"))
    return pf.outlier_table(t).select("column", "iqr_outliers", "z_score_outliers")


@query("K7_quick_profile", f"""
select cast(n as bigint) as rows, 5 as columns, cast(missing as bigint) as missing_cells,
  cast((select sum((u >= 12 or 100.0 * u / n >= 5)::int) from (select unnest([count(distinct l_suppkey), count(distinct l_linenumber), count(distinct quantity),
    count(distinct price)]) as u from {DIRTY})) as int) as numeric_columns from {COUNTS}""")
def quick(spark, d):
    return pf.quick_profile(dirty(spark, d)).select("rows", "columns", F.col("numeric_columns").cast("int"), "missing_cells")


@query("K8_overview_score", f"""
select cast(n as bigint) as rows, cast(missing as bigint) as missing_cells, cast(n - kept as bigint) as duplicate_rows,
  cast(greatest(10, round(100 - 120.0 * missing / (n * 5) - 80.0 * (n - kept) / n)) as int) as score from {COUNTS}""")
def overview(spark, d):
    return pf.overview_score(dirty(spark, d)).drop("columns")


RULES = [{"column": "quantity", "rule_type": "not_null"}, {"column": "quantity", "rule_type": "min_value", "params": {"min": 5}},
         {"column": "price", "rule_type": "max_value", "params": {"max": 90000}},
         {"column": "flag", "rule_type": "allowed_values", "params": {"allowed": ["A", "R"]}},
         {"column": "flag", "rule_type": "regex", "params": {"pattern": "^[ANR]$"}}, {"column": "gone", "rule_type": "not_null"}]
RULE_SQL = [("quantity", "not_null", "quantity is null"), ("quantity", "min_value", "quantity < 5"), ("price", "max_value", "price > 90000"),
            ("flag", "allowed_values", "flag not in ('A', 'R')"), ("flag", "regex", "not regexp_matches(flag, '^[ANR]$')"), ("gone", "not_null", "true")]


@query("K9_K10_evaluate_rules", " union all ".join(
    f"""select {i + 1} as rule, '{c}' as "column", '{k}' as rule_type, cast(count(*) filter (where {t}) as bigint) as violations,
    {r(f'100.0 * count(*) filter (where {t}) / count(*)')} as violation_pct, count(*) filter (where {t}) = 0 as passed from {DIRTY}"""
    for i, (c, k, t) in enumerate(RULE_SQL)))
def rules(spark, d):
    return show(ql.evaluate_rules(dirty(spark, d), RULES))


@query("K9_pass_rate", f"select cast(6 as bigint) as rules, cast(1 as bigint) as passed, {r('100.0 / 6')} as pass_rate from (select count(*) from {DIRTY})")
def pass_rate(spark, d):
    return show(ql.rule_pass_rate(ql.evaluate_rules(dirty(spark, d), RULES)))


def halves(spark, d):
    o = table(spark, d, "orders")
    new = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return o.where(~new), o.where(new)


@query("K11_drift_ks", " union all ".join(f"""
select '{c}' as feature, (select {r('max(abs(fa - fb))', 6)} from (
  select v, sum(sum(a)) over (order by v) / (select count(*) from orders where o_orderdate < timestamp '1998-01-01') as fa,
    sum(sum(b)) over (order by v) / (select count(*) from orders where o_orderdate >= timestamp '1998-01-01') as fb from
    (select {c} as v, (o_orderdate < timestamp '1998-01-01')::int as a, (o_orderdate >= timestamp '1998-01-01')::int as b from orders) group by v)) as ks_statistic,
  {r(f"avg({c}) filter (where o_orderdate < timestamp '1998-01-01')")} as baseline_mean,
  {r(f"avg({c}) filter (where o_orderdate >= timestamp '1998-01-01')")} as current_mean from orders""" for c in ("o_custkey", "o_totalprice")))
def drift(spark, d):
    out = ql.drift_ks(*halves(spark, d), ["o_custkey", "o_totalprice"])
    return out.select("feature", rounded("ks_statistic", 6).alias("ks_statistic"), rounded("baseline_mean").alias("baseline_mean"),
                      rounded("current_mean").alias("current_mean"))


@query("K12_psi", f"""
with old as (select o_totalprice as v from orders where o_orderdate < timestamp '1998-01-01'), new as (select o_totalprice as v from orders where o_orderdate >= timestamp '1998-01-01'),
e as (select unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as edge from old),
ba as (select (select count(*) from e where old.v > edge) as bucket, count(*) * 1.0 / (select count(*) from old) as expected from old group by 1),
bb as (select (select count(*) from e where new.v > edge) as bucket, count(*) * 1.0 / (select count(*) from new) as actual from new group by 1)
select cast(bucket as int) as bucket, {r('expected', 6)} as expected, {r('actual', 6)} as actual, {r('(actual - expected) * ln(actual / expected)', 6)} as psi from ba join bb using (bucket)""")
def psi(spark, d):
    return show(ql.psi(*halves(spark, d), "o_totalprice"), 6)


@query("K13_missing_table", " union all ".join(f"""select '{c}' as "column", cast(count(*) - count({c}) as bigint) as missing_count,
  {r(f'100.0 * (count(*) - count({c})) / count(*)')} as missing_pct from {DIRTY}""" for c in ("quantity", "price", "flag")))
def missing(spark, d):
    return show(pf.missing_table(dirty(spark, d)))


@query("K13_upper_outliers", f"""
select 'squared' as "column", {r('any_value(f)', 2)} as fence, cast(count(*) filter (where v > f) as bigint) as above from (select sqrt(o_totalprice) * o_totalprice as v from orders),
  (select quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) as f from (select sqrt(o_totalprice) * o_totalprice as v from orders))""")
def upper(spark, d):
    t = table(spark, d, "orders").select((F.sqrt("o_totalprice") * F.col("o_totalprice")).alias("squared"))
    return show(pf.upper_outliers(t), 2)


@query("K14_padded_text", """
select 'p_name' as "column", cast(count(*) as bigint) as padded from part where p_size % 3 = 0""")
def padded(spark, d):
    t = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.col("p_name")).alias("p_name"))
    return pf.padded_text(t)


@query("K15_target_leakage", f"""
with t as (select o_totalprice as y, o_totalprice * 2 + 1 as near, o_totalprice as same, o_custkey as other from orders)
select 'near' as feature, {r('corr(near, y)')} as r, false as identical, true as leaks from t union all
select 'same', {r('corr(same, y)')}, true, true from t union all select 'other', {r('corr(other, y)')}, false, false from t""")
def leakage(spark, d):
    t = table(spark, d, "orders").selectExpr("o_totalprice as y", "o_totalprice * 2 + 1 as near", "o_totalprice as same", "o_custkey as other")
    return show(ql.target_leakage(t, "y"))


@query("K15_leakage_text_target", f"""
select 'code' as feature, {r("corr(case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end)")} as r,
  true as identical, true as leaks from orders""")
def leakage_text(spark, d):
    t = table(spark, d, "orders").selectExpr("o_orderstatus", "case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as code")
    return show(ql.target_leakage(t, "o_orderstatus"))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "'x'"]


@query("K16_id_and_constant_columns", " union all ".join(
    f"""select 'id' as kind, '{c.replace("'x'", 'fixed')}' as "column" from (select count(distinct {c}) as u, count(*) as n from orders) where u = n
    union all select 'constant', '{c.replace("'x'", 'fixed')}' from (select count(distinct {c}) as u, count(*) - count({c}) as gaps, count(*) as n from orders)
    where gaps = n or (gaps = 0 and u = 1)""" for c in ORDER_COLUMNS))
def ids(spark, d):
    t = table(spark, d, "orders").withColumn("fixed", F.lit("x"))
    rows = [("id", c) for c in pf.id_columns(t)] + [("constant", c) for c in pf.constant_columns(t)]
    return spark.createDataFrame(rows, "kind string, column string")
