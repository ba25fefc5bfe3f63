"""Descriptive statistics, correlation, hypothesis tests, regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import correlation as co, describe as de, hypothesis as hy, regression as rg
from lumenframe.operators.business import findings
from lumenframe.plans.cleaning import DIRTY, dirty
from lumenframe.plans.registry import query, r, rounded, show, table

SUMMARY = " union all ".join(f"""
select '{c}' as feature, cast(count({c}) as bigint) as n, cast(count(*) - count({c}) as bigint) as missing, {r(f'100.0 * (count(*) - count({c})) / count(*)')} as missing_pct,
  {r(f'avg({c})', 3)} as mean, {r(f'stddev_samp({c})', 3)} as std, {r(f'var_samp({c})', 1)} as variance, {r(f'min({c})', 3)} as min, {r(f'quantile_cont({c}, 0.25)', 3)} as p25,
  {r(f'median({c})', 3)} as p50, {r(f'quantile_cont({c}, 0.75)', 3)} as p75, {r(f'quantile_cont({c}, 0.9)', 3)} as p90, {r(f'quantile_cont({c}, 0.99)', 3)} as p99,
  {r(f'max({c})', 3)} as max, {r(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)', 3)} as iqr, {r(f'skewness({c})')} as skewness, {r(f'kurtosis({c})')} as kurtosis from {DIRTY}"""
                            for c in ("l_suppkey", "quantity", "price"))


@query("L1_numeric_summary", SUMMARY)
def numeric_summary(spark, d):
    raw = de.numeric_summary(dirty(spark, d), ["l_suppkey", "quantity", "price"]).drop("shape")
    digits = {"variance": 1, "skewness": 4, "kurtosis": 4, "missing_pct": 4}
    return raw.select(*[rounded(f.name, digits.get(f.name, 3)).alias(f.name) if f.dataType.typeName() == "double" else f.name
                        for f in raw.schema.fields])


@query("L2_categorical_summary", " union all ".join(f"""
select '{c}' as feature, cast(sum(n) as bigint) as n, cast(count(*) as bigint) as unique_values,
  (select {c} from part where {c} is not null group by 1 order by count(*) desc, 1 limit 1) as top_category, cast(max(n) as bigint) as top_frequency,
  {r('100.0 * max(n) / sum(n)')} as top_pct, cast(count(*) filter (where n < 0.02 * t) as bigint) as rare_categories
from (select {c} as v, count(*) as n, sum(count(*)) over () as t from part where {c} is not null group by 1)""" for c in ("p_name", "p_brand", "p_type")))
def categorical_summary(spark, d):
    return show(de.categorical_summary(table(spark, d, "part")).drop("missing", "missing_pct"))


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]
FEATS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("L3_pearson_pairs", " union all ".join(f"""select '{a}' as var1, '{b}' as var2, cast(count(*) as bigint) as n,
  {r(f'corr({a}, {b})')} as coefficient, abs(corr({a}, {b})) >= 0.8 as collinear from lineitem""" for a, b in PAIRS))
def pearson(spark, d):
    return show(co.pearson_pairs(table(spark, d, "lineitem"), FEATS).drop("strength", "direction"))


@query("L4_correlation_matrix", f"""select 'quantity' as var1, 'price' as var2, cast(count(*) as bigint) as n, {r('corr(quantity, price)')} as coefficient,
  case when corr(quantity, price) >= 0.7 then 'Strong' when corr(quantity, price) >= 0.35 then 'Moderate' else 'Weak' end as strength
  from {DIRTY} where quantity is not null and price is not null""")
def matrix(spark, d):
    return show(co.correlation_matrix(dirty(spark, d), ["quantity", "price"], top=10).drop("direction"))


@query("L5_spearman", f"""
with k as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a,
  rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem)
select 'l_quantity' as var1, 'l_extendedprice' as var2, cast(count(*) as bigint) as n, {r('corr(a, b)')} as coefficient from k""")
def spearman(spark, d):
    return show(co.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("L6_kendall", f"""
with t as (select p_size as x, p_retailprice as y from part),
p as (select sum(sign(a.x - b.x) * sign(a.y - b.y)) as s, sum((a.x = b.x)::int) as tx, sum((a.y = b.y)::int) as ty, count(*) as n0
  from (select *, row_number() over () as i from t) a join (select *, row_number() over () as i from t) b on a.i < b.i)
select 'p_size' as var1, 'p_retailprice' as var2, (select count(*) from t) as n, {r('s / (sqrt(n0 - tx) * sqrt(n0 - ty))', 6)} as coefficient from p""")
def kendall(spark, d):
    return show(co.kendall(table(spark, d, "part"), "p_size", "p_retailprice", rows_per_range=300), 6)


@query("L7_covariance_matrix", " union all ".join(f"select '{a}' as var1, '{b}' as var2, {r(f'covar_samp({a}, {b})', 2)} as covariance from lineitem"
                                                  for a, b in [(x, x) for x in FEATS] + PAIRS))
def covariance(spark, d):
    return show(co.covariance_matrix(table(spark, d, "lineitem"), FEATS), 2)


@query("L8_descriptive", f"""
select cast(count(v) as bigint) as n, {r('avg(v)', 3)} as mean, {r('median(v)', 3)} as median, (select v from (select l_quantity as v from lineitem) group by v order by count(*) desc, v limit 1) as mode,
  {r('stddev_samp(v)')} as std, {r('stddev_samp(v) / sqrt(count(v))')} as std_error, {r('skewness(v)')} as skewness, {r('kurtosis(v)')} as kurtosis,
  {r('quantile_cont(v, 0.1)')} as p10, {r('quantile_cont(v, 0.9)')} as p90, {r('avg(v) - 1.96 * stddev_samp(v) / sqrt(count(v))', 1)} as ci_low,
  {r('avg(v) + 1.96 * stddev_samp(v) / sqrt(count(v))', 1)} as ci_high from (select l_quantity as v from lineitem)""")
def descriptive(spark, d):
    out = show(de.descriptive(table(spark, d, "lineitem"), "l_quantity"))
    return out.select("n", rounded("mean", 3).alias("mean"), rounded("median", 3).alias("median"), "mode", "std", "std_error", "skewness",
                      "kurtosis", "p10", "p90", rounded("ci_low", 1).alias("ci_low"), rounded("ci_high", 1).alias("ci_high"))


@query("L9_normality")
def normality(spark, d):
    return de.descriptive(table(spark, d, "orders"), "o_totalprice").select("column", "n", "normality_p", "is_normal")


WELCH = """(select count(*) filter (where o_orderstatus = 'F') as n1, count(*) filter (where o_orderstatus = 'O') as n2,
  avg(o_totalprice) filter (where o_orderstatus = 'F') as m1, avg(o_totalprice) filter (where o_orderstatus = 'O') as m2,
  var_samp(o_totalprice) filter (where o_orderstatus = 'F') as v1, var_samp(o_totalprice) filter (where o_orderstatus = 'O') as v2 from orders)"""


@query("L10_welch_t", f"""select n1, n2, {r('m1', 2)} as mean1, {r('m2', 2)} as mean2, {r('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')} as statistic,
  {r('pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))', 2)} as dof,
  {r('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))', 6)} as effect_size from {WELCH}""")
def welch(spark, d):
    out = hy.welch_t(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", ["F", "O"])
    return out.select("n1", "n2", rounded("mean1", 2).alias("mean1"), rounded("mean2", 2).alias("mean2"), rounded("statistic").alias("statistic"),
                      rounded("dof", 2).alias("dof"), rounded("effect_size", 6).alias("effect_size"))


@query("L11_paired_t", f"""select cast(count(*) as bigint) as n, {r('avg(d)')} as mean_difference, {r('avg(d) / (stddev_samp(d) / sqrt(count(*)))', 3)} as statistic,
  {r('avg(d) / stddev_samp(d)')} as effect_size from (select l_discount - l_tax as d from lineitem)""")
def paired(spark, d):
    out = hy.paired_t(table(spark, d, "lineitem"), "l_discount", "l_tax").drop("p_value")
    return show(out).withColumn("statistic", rounded("statistic", 3))


@query("L12_anova", f"""
with g as (select o_orderpriority, count(*) as n, avg(o_totalprice) as m, var_pop(o_totalprice) * count(*) as ss from orders group by 1 having count(*) > 2),
a as (select sum(n * m) / sum(n) as grand, (select avg(o_totalprice) from orders) as everyone, sum(n) as n, count(*) as k from g)
select cast(max(k) as bigint) as groups, cast(max(a.n) as bigint) as n, {r('(sum(g.n * pow(m - grand, 2)) / (max(k) - 1)) / (sum(ss) / (max(a.n) - max(k)))', 5)} as statistic,
  {r('sum(g.n * pow(m - everyone, 2)) / (sum(ss) + sum(g.n * pow(m - everyone, 2)))', 6)} as effect_size from g, a""")
def anova(spark, d):
    out = hy.anova(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return out.select("groups", "n", rounded("statistic", 5).alias("statistic"), rounded("effect_size", 6).alias("effect_size"))


def _chi(a: str, b: str, source: str, yates: bool) -> str:
    dev = "greatest(abs(coalesce(o, 0) - e) - 0.5, 0)" if yates else "(coalesce(o, 0) - e)"
    return f"""
with c as (select {a} as a, {b} as b, count(*) as o from {source} group by 1, 2), ra as (select a, sum(o) as ra from c group by 1), cb as (select b, sum(o) as cb from c group by 1),
full_table as (select ra.a, cb.b, ra * cb * 1.0 / (select sum(o) from c) as e from ra, cb)
select cast((select sum(o) from c) as bigint) as n, cast(((select count(*) from ra) - 1) * ((select count(*) from cb) - 1) as bigint) as dof, {r(f'sum(pow({dev}, 2) / e)', 5)} as statistic,
  {r(f'sqrt(sum(pow({dev}, 2) / e) / ((select sum(o) from c) * (least((select count(*) from ra), (select count(*) from cb)) - 1)))', 6)} as effect_size
from full_table left join c using (a, b)"""


def chi_run(a, b, name):
    def run(spark, d):
        out = hy.chi_square(table(spark, d, name), a, b)
        return out.select("n", "dof", rounded("statistic", 5).alias("statistic"), rounded("effect_size", 6).alias("effect_size"))
    return run


query("L13_chi_square", _chi("o_orderstatus", "o_orderpriority", "orders", False))(chi_run("o_orderstatus", "o_orderpriority", "orders"))
query("L13_chi_square_sparse", _chi("p_name", "p_size", "part", False))(chi_run("p_name", "p_size", "part"))
query("L13_chi_square_two_by_two", _chi("quality", "toxic", "labels", True))(chi_run("quality", "toxic", "labels"))


@query("L14_mann_whitney", f"""
with t as (select l_quantity as v, (l_returnflag = 'A')::int as one from lineitem where l_returnflag in ('A', 'R')),
k as (select one, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as rk from t),
s as (select sum(one) as n1, sum(1 - one) as n2, sum(rk * one) as r1 from k)
select cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, {r('r1 - n1 * (n1 + 1) / 2', 1)} as statistic, {r('1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2)', 6)} as effect_size from s""")
def mann_whitney(spark, d):
    out = hy.mann_whitney(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", ["A", "R"])
    return out.select("n1", "n2", rounded("statistic", 1).alias("statistic"), rounded("effect_size", 6).alias("effect_size"))


def _ways(start: str, step: str, upto: int) -> str:
    """Numbers of ways by adding one rank after the other, as a chain of tables w0, w1, ...; each holds (n, picked, s, ways)."""
    chain = [f"w0 as (select {start})"]
    for i in range(1, upto + 1):
        chain.append(f"""w{i} as (select {i} as n, picked, s, sum(ways)::double as ways from (
            select picked, s, ways from w{i - 1} union all select {step.format(i=i)}, s + {i}, ways from w{i - 1}) group by picked, s)""")
    return ", ".join(chain) + ", w as (" + " union all ".join(f"select n, picked, s, ways from w{i}" for i in range(upto + 1)) + ")"


@query("L14_mann_whitney_per_customer", f"""
with {_ways("0 as n, 0 as picked, 0 as s, 1::double as ways", "picked + 1", 40)},
t as (select o_custkey, o_totalprice as v, (o_orderstatus = 'F')::int as one from orders where o_orderstatus in ('F', 'O')),
k as (select *, rank() over (partition by o_custkey order by v) + (count(*) over (partition by o_custkey, v) - 1) / 2.0 as rk, count(*) over (partition by o_custkey, v) as alike from t),
g as (select o_custkey, sum(one) as n1, sum(1 - one) as n2, sum(rk * one) - sum(one) * (sum(one) + 1) / 2 as u, max(alike) as alike from k group by 1),
e as (select *, alike = 1 and least(n1, n2) between 1 and 8 as exact from g),
p as (select o_custkey, least(1.0, 2 * sum(ways) filter (where s - n1 * (n1 + 1) / 2 <= least(u, n1 * n2 - u)) / sum(ways)) as p
  from e join w on w.n = n1 + n2 and w.picked = n1 where exact group by o_custkey)
select o_custkey, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, {r('u', 1)} as statistic, exact, {r('p', 6)} as exact_p from e left join p using (o_custkey)""")
def mann_whitney_per_customer(spark, d):
    out = hy.mann_whitney_per(table(spark, d, "orders"), "o_totalprice", "o_orderstatus", ["F", "O"], ["o_custkey"])
    return out.select("o_custkey", "n1", "n2", rounded("statistic", 1).alias("statistic"), "exact", rounded(F.when(F.col("exact"), F.col("p_value")), 6).alias("exact_p"))


@query("L16_wilcoxon_per_customer", f"""
with {_ways("0 as n, 0 as picked, 0 as s, 1::double as ways", "0", 50)},
k as (select o_custkey, x, rank() over (partition by o_custkey order by abs(x)) + (count(*) over (partition by o_custkey, abs(x)) - 1) / 2.0 as rk, count(*) over (partition by o_custkey, abs(x)) as alike
  from (select o_custkey, o_totalprice - 225000 as x from orders) where x <> 0),
g as (select o_custkey, count(*) as n, coalesce(sum(rk) filter (where x > 0), 0) as plus, max(alike) as alike from k group by 1),
e as (select *, least(plus, n * (n + 1) / 2 - plus) as low, alike = 1 and n <= 50 as exact from g),
p as (select o_custkey, least(1.0, 2 * sum(ways) filter (where s <= low) / sum(ways)) as p from e join w on w.n = e.n where exact group by o_custkey)
select o_custkey, cast(n as bigint) as n, {r('low', 1)} as statistic, exact, {r('p', 6)} as exact_p from e left join p using (o_custkey)""")
def wilcoxon_per_customer(spark, d):
    t = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.lit(225000.0).alias("level"))
    out = hy.wilcoxon_per(t, "o_totalprice", "level", ["o_custkey"])
    return out.select("o_custkey", "n", rounded("statistic", 1).alias("statistic"), "exact", rounded(F.when(F.col("exact"), F.col("p_value")), 6).alias("exact_p"))


@query("L15_kruskal_wallis", f"""
with k as (select l_returnflag as g, l_quantity as v, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as rk from lineitem),
g as (select g, count(*) as n, sum(rk) as s from k group by 1), t as (select sum(pow(c, 3) - c) as t from (select count(*) * 1.0 as c from k group by v)),
a as (select sum(n) * 1.0 as n, sum(s * s / n) as q, count(*) as groups from g)
select groups, cast(n as bigint) as n, {r('(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n))', 5)} as statistic from a, t""")
def kruskal(spark, d):
    out = hy.kruskal_wallis(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return out.select("groups", "n", rounded("statistic", 5).alias("statistic"))


@query("L16_wilcoxon", f"""
with k as (select x, rank() over (order by abs(x)) + (count(*) over (partition by abs(x)) - 1) / 2.0 as rk
  from (select round(l_discount - l_tax, 2) as x from lineitem) where x <> 0)
select cast(count(*) as bigint) as n, {r('least(sum(rk) filter (where x > 0), sum(rk) filter (where x < 0))', 1)} as statistic from k""")
def wilcoxon(spark, d):
    t = table(spark, d, "lineitem").select(F.round(F.col("l_discount") - F.col("l_tax"), 2).alias("x"), F.lit(0.0).alias("zero"))
    return hy.wilcoxon(t, "x", "zero").select("n", rounded("statistic", 1).alias("statistic"))


@query("L10_L16_p_values")
def p_values(spark, d):
    o = table(spark, d, "orders")
    tests = {"welch": hy.welch_t(o, "o_totalprice", "o_orderstatus", ["F", "O"]), "anova": hy.anova(o, "o_totalprice", "o_orderpriority"),
             "chi_square": hy.chi_square(o, "o_orderstatus", "o_orderpriority"),
             "kruskal": hy.kruskal_wallis(o, "o_totalprice", "o_orderpriority")}
    out = None
    for name, t in tests.items():
        one = t.select(F.lit(name).alias("test"), rounded("p_value").alias("p_value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("L17_ols_one_feature", f"""select {r('regr_slope(l_extendedprice, l_quantity)', 3)} as coefficient, {r('regr_intercept(l_extendedprice, l_quantity)', 2)} as intercept,
  {r('regr_r2(l_extendedprice, l_quantity)')} as r2, {r('1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2)')} as adjusted_r2,
  {r('sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / count(*))', 2)} as rmse,
  {r('regr_slope(l_extendedprice, l_quantity) / sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity))', 2)} as t from lineitem""")
def ols_one(spark, d):
    fit = rg.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return fit.coefficients.crossJoin(fit.summary).select(
        rounded("coefficient", 3).alias("coefficient"), rounded("intercept", 2).alias("intercept"), rounded("r2").alias("r2"),
        rounded("adjusted_r2").alias("adjusted_r2"), rounded("rmse", 2).alias("rmse"), rounded("t", 2).alias("t"))


@query("L17_L18_ols_two_features", f"""
with c as (select covar_samp(l_quantity, l_discount) as sab, var_samp(l_quantity) as saa, var_samp(l_discount) as sbb, covar_samp(l_extendedprice, l_quantity) as say,
  covar_samp(l_extendedprice, l_discount) as sby, corr(l_quantity, l_discount) as r from lineitem)
select 'l_quantity' as feature, {r('(say * sbb - sby * sab) / (saa * sbb - sab * sab)', 3)} as coefficient, {r('1 / (1 - r * r)', 6)} as vif from c union all
select 'l_discount', {r('(sby * saa - say * sab) / (saa * sbb - sab * sab)', 3)}, {r('1 / (1 - r * r)', 6)} from c""")
def ols_two(spark, d):
    fit = rg.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return fit.coefficients.select("feature", rounded("coefficient", 3).alias("coefficient"), rounded("vif", 6).alias("vif"))


@query("L19_logistic")
def logistic(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_discount")
    fit = rg.logistic(t, "y", ["l_quantity", "l_discount"], max_iter=50)
    return fit.coefficients.crossJoin(fit.summary)


@query("L20_L21_polynomial_ols")
def polynomial(spark, d):
    return rg.polynomial_ols(table(spark, d, "part"), "p_retailprice", ["p_size"], 2).coefficients


@query("L22_association_continuous", f"""
select 'l_quantity' as feature, 'Pearson r' as metric, {r('corr(l_quantity, l_extendedprice)')} as score from lineitem union all
select 'l_discount', 'Pearson r', {r('corr(l_discount, l_extendedprice)')} from lineitem""")
def association(spark, d):
    t = table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount")
    return show(co.target_association(t, "l_extendedprice").drop("p_value"))


def _f(c: str) -> str:
    return f"""select '{c}' as feature, 'ANOVA F' as metric, {r('(sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*)))', 3)} as score
  from (select count(*) as n, avg({c}) as m, var_pop({c}) * count(*) as ss from lineitem group by l_returnflag), (select avg({c}) as grand from lineitem)"""


@query("L22_association_class", _f("l_quantity") + " union all " + _f("l_extendedprice"))
def association_class(spark, d):
    t = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return show(co.target_association(t, "l_returnflag").drop("p_value"), 3)


@query("L23_qq_points", f"""
with q as (select quantile_cont(o_totalprice, [{', '.join(str((i + 0.5) / 20) for i in range(20))}]) as q from orders)
select cast(generate_subscripts(q, 1) as int) as point, {r('unnest(q)', 3)} as sample from q""")
def qq(spark, d):
    return de.qq_points(table(spark, d, "orders"), "o_totalprice", 20).select("point", rounded("sample", 3).alias("sample"))


@query("L24_density", f"""
with s as (select min(o_totalprice) as lo, max(o_totalprice) as hi, stddev_samp(o_totalprice) * pow(count(*), -0.2) as h, count(*) as n from orders),
g as (select i, lo + (hi - lo) * i / 24 as x, h, n from s, (select unnest(range(25)) as i))
select {r('x', 2)} as x, {r('1e6 * sum(exp(-0.5 * pow((x - o_totalprice) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi()))')} as density_e6 from g, orders group by x""")
def density(spark, d):
    out = de.density(table(spark, d, "orders"), "o_totalprice", 25)
    return out.select(rounded("x", 2).alias("x"), rounded(F.col("density") * 1e6).alias("density_e6"))


@query("L25_trend_line", f"""select {r('regr_slope(p_retailprice, p_partkey)', 6)} as slope, {r('regr_intercept(p_retailprice, p_partkey)')} as intercept,
  {r('regr_r2(p_retailprice, p_partkey)')} as r2, cast(count(*) as bigint) as n from part""")
def trend(spark, d):
    out = de.trend_line(table(spark, d, "part"), "p_partkey", "p_retailprice")
    return out.select(rounded("slope", 6).alias("slope"), rounded("intercept").alias("intercept"), rounded("r2").alias("r2"), "n")


PAIR_LIST = " union all ".join(f"select '{a} & {b}' as subject, corr({a}, {b}) as c from lineitem" for a, b in PAIRS)


@query("L26_findings", f"""
select 'strongest_pair' as kind, subject, {r('c')} as value from (select * from ({PAIR_LIST}) order by abs(c) desc limit 1) union all
select 'severe_skew', 'tail', {r('skewness(exp(l_quantity / 10))')} from lineitem""")
def find(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    a = findings(t)
    b = findings(table(spark, d, "lineitem").select(F.exp(F.col("l_quantity") / 10).alias("tail")))
    return show(a.unionByName(b).drop("detail"))


@query("L27_column_answers", f"""
select 'o_totalprice' as column, cast(count(v) as bigint) as n, {r('avg(v)', 2)} as mean, {r('median(v)', 2)} as median, {r('min(v)', 2)} as min, {r('max(v)', 2)} as max,
  {r('max(v) / avg(v)', 2)} as peak_ratio, {r('sum(v)', 2)} as total, {r('stddev_samp(v)', 2)} as std, {r('quantile_cont(v, 0.25)', 2)} as q25,
  {r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 2)} as iqr, {r('any_value(p)', 2)} as p95, cast(count(*) filter (where v > p) as bigint) as above_p95
from (select o_totalprice as v from orders), (select quantile_cont(o_totalprice, 0.95) as p from orders)""".replace("as column", 'as "column"'))
def answers(spark, d):
    return show(de.column_answers(table(spark, d, "orders"), ["o_totalprice"]).drop("missing"), 2)
