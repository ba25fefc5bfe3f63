"""Text, date and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import dates, maths, text
from lumenframe.operators import cleaning, scaling
from lumenframe.plans.registry import query, r, show, table


def text_query(number: str, operation: str, sql: str, source: str = "part", key: str = "p_partkey", column: str = "p_name", **options):
    def run(spark, d):
        return text.text_transform(table(spark, d, source), column, operation, "out", **options).select(key, "out")
    query(f"{number}_text_{operation}", f"select {key}, {sql} as out from {source}")(run)


text_query("I1", "upper", "upper(p_name)")
text_query("I2", "lower", "lower(text)", "documents", "doc_id", "text")
text_query("I3", "title", "list_aggregate(list_transform(regexp_extract_all(lower(c_name), '[a-z]+|[^a-z]+'), "
           "lambda w: upper(w[1]) || w[2:]), 'string_agg', '')", "customer", "c_custkey", "c_name")
text_query("I4", "strip", "regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '')", "documents", "doc_id", "text")
text_query("I5", "replace", "replace(p_name, 'ring', 'RING.')", pattern="ring", replacement="RING.")
text_query("I6", "extract_regex", "regexp_extract(url, '(https?)://([a-z.]+)', 0)", "pages", "page_id", "url", pattern="https?://[a-z.]+")
text_query("I8", "pad_right", "p_name || repeat(' ', greatest(12 - length(p_name), 0))", width=12)
text_query("I9", "length", "cast(length(text) as int)", "documents", "doc_id", "text")
text_query("I10", "contains_flag", "regexp_matches(text, 'the |licen', 'i')", "documents", "doc_id", "text", pattern="the |licen")
text_query("I11", "remove_special", "regexp_replace(url, '[^A-Za-z0-9 \\t\\n\\r\\f\\v]', '', 'g')", "pages", "page_id", "url")
text_query("I12a", "split_first", "split_part(url, '/', 1)", "pages", "page_id", "url", pattern="/")
text_query("I12b", "split_last", "case when contains(url, '#') then split_part(url, '#', -1) end", "pages", "page_id", "url", pattern="#")


@query("I7_text_pad_left", """
select c_custkey, case when v[1] in ('-', '+') then v[1] || repeat('0', greatest(10 - length(v), 0)) || v[2:]
  else repeat('0', greatest(10 - length(v), 0)) || v end as out
from (select c_custkey, cast(cast(c_acctbal * 100 - 300000 as bigint) as varchar) as v from customer)""")
def pad_left(spark, d):
    t = table(spark, d, "customer").withColumn("v", F.bround(F.col("c_acctbal") * 100 - 300000).cast("bigint").cast("string"))
    return text.text_transform(t, "v", "pad_left", "out", width=10).select("c_custkey", "out")


@query("I13_I14_replace_in_text", """
select p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') as p_name,
  case p_type when 'SMALL' then 'S' when 'LARGE' then 'L' else regexp_replace(p_type, '[aeiou]', '*', 'g') end as p_type from part""")
def replace_all(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return cleaning.standardize_text(t, dedup_rows=False, trim=False, replace={"SMALL": "S", "LARGE": "L"}, regex=("[aeiou]", "*"))


@query("I15_repair_unicode", "select doc_id, text from documents")
def repair(spark, d):
    return table(spark, d, "documents").select("doc_id", text.repair_unicode(F.col("text")).alias("text"))


@query("I16_mask_secrets", """
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '([a-zA-Z0-9_+.-]+://[^:]+:)([^@\\s]+)(@)', '\\1********\\3', 'gi'),
  '((?:password|pwd|secret|token|api[_-]?key|private[_-]?key|auth)\\s*[:=]\\s*["'']?)([^"''\\s,;}]+)(["'']?)', '\\1********\\3', 'gi'),
  '(Bearer\\s+)[a-zA-Z0-9_\\-\\.]{15,}', '\\1[REDACTED_BEARER_TOKEN]', 'gi'),
  '-----BEGIN [A-Z ]+PRIVATE KEY-----[^-]+-----END [A-Z ]+PRIVATE KEY-----', '[REDACTED_PRIVATE_KEY_BLOCK]', 'gs') as masked
from documents""")
def mask(spark, d):
    return table(spark, d, "documents").select("doc_id", text.mask_secrets(F.col("text")).alias("masked"))


DATES = {
    "I17_extract_year": "year(o_orderdate)", "I18_extract_month": "month(o_orderdate)", "I19_extract_day": "day(o_orderdate)",
    "I20_extract_weekday": "dayname(o_orderdate)", "I22_extract_quarter": "quarter(o_orderdate)",
    "I23_extract_week": "weekofyear(o_orderdate)", "I26_is_weekend": "isodow(o_orderdate) >= 6",
    "I27_month_name": "monthname(o_orderdate)", "I28_trunc_month": "cast(date_trunc('month', o_orderdate) as timestamp)",
    "I24_date_diff_today": "date_diff('day', o_orderdate, timestamp '2002-01-01')",
    "I25_to_string": "strftime(o_orderdate, '%d.%m.%Y (%j)')",
}


def date_query(name: str, sql: str) -> None:
    operation = name.split("_", 1)[1]
    whole = any(w in operation for w in ("year", "month", "day", "quarter", "week", "diff")) and operation not in (
        "month_name", "extract_weekday", "is_weekend", "trunc_month")
    expr = f"cast({sql} as int)" if whole else sql

    def run(spark, d):
        out = dates.date_transform(table(spark, d, "orders"), "o_orderdate", operation, "out", "%d.%m.%Y (%j)",
                                   F.lit("2002-01-01").cast("timestamp"))
        value = F.col("out").cast("timestamp_ntz") if operation == "trunc_month" else F.col("out")
        return out.select("o_orderkey", value.alias("out"))
    query(f"{name}", f"select o_orderkey, {expr} as out from orders")(run)


for _name, _sql in DATES.items():
    date_query(_name, _sql)


@query("I21_extract_hour", "select event_id, cast(hour(ts) as int) as out from events")
def hour(spark, d):
    return dates.date_transform(table(spark, d, "events"), "ts", "extract_hour", "out").select("event_id", "out")


MATHS = {
    "I29a_log": f"ln(greatest(v, 1e-9))", "I29b_log10": "log10(greatest(v, 1e-9))", "I29c_sqrt": "sqrt(greatest(v, 0))",
    "I29d_abs": "abs(v)", "I29e_square": "v * v", "I29g_ceiling": "ceil(v)", "I29h_floor": "floor(v)",
    "I29i_invert": "1 / (v + 1e-9)", "I29j_exp": "exp(v)",
}


def shifted(spark, d):
    """Balances around zero, some missing."""
    return table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal") / 1000 - 3).alias("v"))


SHIFTED = "(select c_custkey, case when c_custkey % 17 = 0 then null else c_acctbal / 1000 - 3 end as v from customer)"


def math_query(name: str, sql: str) -> None:
    operation = name.split("_", 1)[1]
    query(name, f"select c_custkey, {r(f'case when v is not null then {sql} end')} as out from {SHIFTED}")(
        lambda spark, d: show(maths.math_transform(shifted(spark, d), "v", operation, "out").select(
            "c_custkey", F.col("out").cast("double").alias("out"))))


for _name, _sql in MATHS.items():
    math_query(_name, _sql)


@query("I29f_round", f"select o_orderkey, {r('round(o_totalprice / 7, 2)')} as out from orders")
def round_two(spark, d):
    t = table(spark, d, "orders").withColumn("v", F.col("o_totalprice") / 7)
    return show(maths.math_transform(t, "v", "round", "out", 2).select("o_orderkey", "out"))


@query("I30_normalize_standardize", f"""
with s as (select min(v) lo, max(v) hi, avg(v) m, stddev_samp(v) sd from {SHIFTED})
select c_custkey, {r('(v - lo) / (hi - lo + 1e-9)')} as normalized, {r('(v - m) / (sd + 1e-9)')} as standardized from {SHIFTED}, s""")
def normalize(spark, d):
    t = scaling.normalize(shifted(spark, d), "v", "normalize", "normalized", None)
    return show(scaling.normalize(t, "v", "standardize", "standardized", None).drop("v"))


@query("I31_pct_of_total", f"select o_orderkey, {r('100 * o_totalprice / (select sum(o_totalprice) from orders)', 6)} as out from orders")
def pct_of_total(spark, d):
    return show(scaling.pct_of_total(table(spark, d, "orders"), "o_totalprice", "out", None).select("o_orderkey", "out"), 6)


@query("I32_cumulative_pct", f"""
select o_orderkey, {r('100 * sum(o_totalprice) over (order by o_orderdate, o_orderkey rows unbounded preceding) / sum(o_totalprice) over ()')} as out from orders""")
def cumulative_pct(spark, d):
    out = scaling.cumulative_pct(table(spark, d, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], "out", None)
    return show(out.select("o_orderkey", "out"))


@query("I33_M2_log1p_sqrt", f"""
select c_custkey, {r(f'ln(1 + greatest(v + case when lo < 0 then -lo else 0 end, 0))')} as v_log1p, {r('sqrt(greatest(v, 0))')} as v_sqrt
from (select *, case when v is null then null else v end as w from {SHIFTED}) t, (select min(v) as lo from {SHIFTED}) where v is not null
union all select c_custkey, null, null from {SHIFTED} where v is null""")
def log1p(spark, d):
    t = scaling.transform_skewed(shifted(spark, d), ["v"], "log1p", decimals=None)
    return show(scaling.transform_skewed(t, ["v"], "sqrt", decimals=None).drop("v"))
