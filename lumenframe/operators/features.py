"""Encodings, date and text features, interactions, recommendations, automatic features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import (
    col, number, numeric_columns, require, safe_div, safe_name, string_columns, time_columns, to_time)
from lumenframe.functions.dates import is_weekend, season
from lumenframe.operators.ordered import layout, over_rows
from lumenframe.operators.profile import feature_categories, value_facts, wide_facts
from lumenframe.operators.ranks import lookup, value_ranks
from lumenframe.operators.regression import polynomial_terms
from lumenframe.operators.scaling import scale_features, transform_skewed
from lumenframe.operators.windows import pct_change

# The sentiment word lists.
POSITIVE_WORDS = ["good", "great", "excellent", "amazing", "love", "satisfied", "happy", "fast", "helpful",
                  "pro", "best", "super"]
NEGATIVE_WORDS = ["bad", "poor", "terrible", "slow", "broken", "worst", "unhappy", "delay", "error", "fail",
                  "hate", "issue"]


def one_hot(df: DataFrame, columns: Sequence[str], max_categories: int = 10, drop_first: bool = False,
            drop_original: bool = False) -> DataFrame:
    """0/1 columns per value; beyond the most frequent ``max_categories`` values share "Other"."""
    require(df, columns)
    out: dict[str, Column] = {}
    for c in columns:
        text = F.coalesce(col(c).cast("string"), F.lit("nan"))
        counts = df.groupBy(text.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        found = [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(max_categories + 1).collect()]
        kept = found[:max_categories]
        labels = sorted(kept + (["Other"] if len(found) > max_categories and "Other" not in kept else []))
        value = F.when(text.isin(kept), text).otherwise("Other")
        for label in labels[1:] if drop_first else labels:
            name = safe_name(c) + "_" + "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in label)
            hit = (value == label).cast("int")
            out[name] = F.greatest(out[name], hit) if name in out else hit
    done = df.withColumns(out)
    return done.drop(*columns) if drop_original else done


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Position of the value in the sorted text values, from 0; null stays null."""
    out = name or f"{column}_encoded"
    text = df.withColumn("__text", col(column).cast("string"))
    ranks = value_ranks(text, "__text").withColumn(out, (F.col("__dense") - 1).cast("double"))
    return lookup(text, ranks, ["__text"], [out], "__n").drop("__text")


def frequency_encode(df: DataFrame, column: str, name: str | None = None, decimals: int | None = 4) -> DataFrame:
    """Share of the non-null rows that hold the value."""
    out = name or f"{column}_freq"
    known = df.where(col(column).isNotNull())
    counts = known.groupBy(col(column)).agg(F.count(F.lit(1)).alias("__n"))
    share = F.col("__n") / known.agg(F.count(F.lit(1))).scalar()
    return lookup(df, counts.withColumn(out, share if decimals is None else F.bround(share, decimals)), [column], [out], "__n")


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 10.0, name: str | None = None,
                  decimals: int | None = 4) -> DataFrame:
    """(n mean + s overall) / (n + s) per value; null and unseen values take the overall mean."""
    out = name or f"{column}_target_enc"
    y = number(df, target)
    overall = df.agg(F.avg(y)).scalar()
    table = df.where(col(column).isNotNull()).groupBy(col(column)).agg(
        F.count(y).alias("__known"), F.avg(y).alias("__mean"), F.count(F.lit(1)).alias("__n"))
    smooth = F.when(F.col("__known") > 0, (F.col("__known") * F.col("__mean") + smoothing * overall)
                    / (F.col("__known") + smoothing))
    done = lookup(df, table.withColumn(out, smooth), [column], [out], "__n")
    value = F.coalesce(col(out), overall)
    return done.withColumn(out, value if decimals is None else F.bround(value, decimals))


def encode_for_models(df: DataFrame, target: str, low: int = 15) -> DataFrame:
    """Text columns: 0/1 columns without the first value up to 15 values, else their frequency."""
    texts = [c for c in string_columns(df) if c != target]
    unique = value_facts(df, texts)
    few = [c for c in texts if unique[c]["unique"] <= low]
    out = df
    for c in few:
        found = sorted(r[0] for r in df.where(col(c).isNotNull()).select(col(c)).distinct().collect())
        out = out.withColumns({f"{c}_{v}": F.coalesce((col(c) == v).cast("double"), F.lit(0.0)) for v in found[1:]})
    for c in texts:
        if c not in few:
            out = frequency_encode(out, c, f"{c}_freq_enc", decimals=None)
            out = out.fillna(0.0, subset=[f"{c}_freq_enc"])
    return out.drop(*texts)


def date_features(df: DataFrame, columns: Sequence[str], drop_original: bool = False) -> DataFrame:
    """Year, month, day, weekday (Monday 0), weekend, quarter, season; hour if it varies."""
    require(df, columns)
    hours = df.agg(*[(F.max(F.hour(to_time(df, c))) > F.min(F.hour(to_time(df, c)))) for c in columns]).first()
    out: dict[str, Column] = {}
    for c, varies in zip(columns, hours):
        t, p = to_time(df, c), safe_name(c)
        out |= {f"{p}_year": F.year(t), f"{p}_month": F.month(t), f"{p}_day": F.dayofmonth(t),
                f"{p}_dayofweek": F.weekday(t), f"{p}_is_weekend": is_weekend(t).cast("int"),
                f"{p}_quarter": F.quarter(t), f"{p}_season": season(t)}
        if varies:
            out[f"{p}_hour"] = F.hour(t)
    done = df.withColumns(out)
    return done.drop(*columns) if drop_original else done


def interaction(df: DataFrame, a: str, b: str, operation: str = "ratio", name: str | None = None,
                decimals: int | None = 4) -> DataFrame:
    """ratio (null where b is 0), product, sum or difference."""
    x, y = number(df, a), number(df, b)
    forms = {"ratio": safe_div(x, y), "product": x * y, "sum": x + y, "difference": x - y}
    if operation not in forms:
        raise ValueError(f"unknown interaction: {operation}")
    value = forms[operation]
    return df.withColumn(name or f"{a}_{operation}_{b}", value if decimals is None else F.bround(value, decimals))


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """Powers and products up to a degree; gaps take the column mean."""
    row = df.agg(*[F.avg(number(df, c)) for c in columns]).first()
    filled = df.withColumns({f"__raw_{c}": col(c) for c in columns}).withColumns(
        {c: F.coalesce(number(df, c), F.lit(m)) for c, m in zip(columns, row)})
    wide, _ = polynomial_terms(filled, columns, degree)
    return wide.withColumns({c: col(f"__raw_{c}") for c in columns}).drop(*[f"__raw_{c}" for c in columns])


def rolling_features(df: DataFrame, column: str, window: int, order_by, partition_by: Sequence[str] = (),
                     operations: Sequence[str] = ("mean", "std"), **scan) -> DataFrame:
    """Rolling mean and deviation (0 for one row); percent change with 0 in the first row."""
    specs = {}
    scan.setdefault("shared", layout(df, order_by, partition_by, scan.get("ranges")))
    if "mean" in operations:
        specs[f"{column}_roll_mean_{window}"] = F.avg(col(column))
    if "std" in operations:
        specs[f"{column}_roll_std_{window}"] = F.stddev_samp(col(column))
    out = over_rows(df, specs, window - 1, 0, order_by, partition_by, **scan) if specs else df
    if "std" in operations:
        out = out.fillna(0.0, subset=[f"{column}_roll_std_{window}"])
    if "pct_change" in operations:
        name = f"{column}_pct_change"
        out = pct_change(out, column, 1, order_by, partition_by, name, **scan)
        out = out.withColumn(name, F.coalesce(col(name) * 100, F.lit(0.0)))
    return out


def text_features(df: DataFrame, column: str) -> DataFrame:
    """Characters, words, digits, and (positive - negative) / both over the distinct words."""
    text = F.coalesce(col(column).cast("string"), F.lit(""))

    small = F.lower(text)

    def hits(words: Sequence[str]) -> Column:
        """How many of the words occur; the pattern runs only where the letters occur at all."""
        return sum((F.when(F.contains(small, F.lit(w)), F.regexp_like(small, F.lit(rf"(?U)\b{w}\b")).cast("int")).otherwise(0)
                    for w in words), F.lit(0))

    pos, neg = hits(POSITIVE_WORDS), hits(NEGATIVE_WORDS)
    score = F.coalesce(F.bround(safe_div((pos - neg).cast("double"), pos + neg), 2), F.lit(0.0))
    return df.withColumns({
        f"{column}_char_count": F.length(text),
        f"{column}_word_count": F.regexp_count(text, F.lit(r"(?U)\S+")),
        f"{column}_digits_count": F.regexp_count(text, F.lit(r"\p{Nd}")),
        f"{column}_sentiment_score": score})


# Name parts of column pairs that make a useful ratio or difference.
PAIR_RULES = [
    ("charge", "month", "ratio"), ("charge", "tenure", "ratio"), ("sqft", "bedroom", "ratio"),
    ("price", "sqft", "ratio"), ("revenue", "cost", "difference"),
]


def recommendations(df: DataFrame, kinds: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(column, type, detail) suggestions from skew, column kinds and column names."""
    kinds = kinds or feature_categories(df)
    rows, wide = wide_facts(df)
    out = []
    for c in kinds["numerical"]:
        f = wide[c]
        if rows - f["missing"] > 10 and f["skew"] is not None and abs(f["skew"]) > 1.2 and f["min"] >= 0:
            out.append((c, "log_transform", f"skew {f['skew']:.2f}"))
    out += [(c, "date_parts", "year to season") for c in kinds["datetime"]]
    out += [(c, "one_hot", "few values") for c in kinds["categorical_low"]]
    out += [(c, "frequency_or_target", "many values") for c in kinds["categorical_high"]]
    numbers = kinds["numerical"]
    for i, a in enumerate(numbers):
        for b in numbers[i + 1:]:
            for first, second, kind in PAIR_RULES:
                if first in a.lower() and second in b.lower():
                    out.append((f"{a} & {b}", kind, f"{a} and {b}"))
                    break
    return df.sparkSession.createDataFrame(out, "column string, type string, detail string")


def auto_features(df: DataFrame) -> DataFrame:
    """Two dates, three logs, three 0/1 encodings (up to 6 values), three standard scales, one ratio."""
    kinds = feature_categories(df)
    advice = recommendations(df, kinds).collect()
    _, wide = wide_facts(df)
    out = date_features(df, kinds["datetime"][:2]) if kinds["datetime"] else df
    logs = [r["column"] for r in advice if r["type"] == "log_transform"][:3]
    if logs:
        out = transform_skewed(out, logs, "log1p")
    unique = value_facts(df, kinds["categorical_low"])
    few = [c for c in kinds["categorical_low"] if unique[c]["unique"] <= 6][:3]
    if few:
        out = one_hot(out, few, max_categories=6)
    wide_enough = [c for c in kinds["numerical"] if (wide[c]["std"] or 0) > 1][:3]
    if wide_enough:
        out = scale_features(out, wide_enough, "standard")
    ratios = [r["column"].split(" & ") for r in advice if r["type"] == "ratio"]
    if ratios:
        out = interaction(out, *ratios[0], "ratio")
    return out


def model_features(df: DataFrame, target: str) -> DataFrame:
    """Date parts, log1p of skewed positive columns, and a / (|b| + 1e-5) of the first two numbers."""
    numbers = [c for c in numeric_columns(df) if c != target]
    out = df
    for c in [t for t in time_columns(df) if t != target]:
        t = to_time(df, c)
        out = out.withColumns({
            f"{c}_year": F.year(t).cast("double"), f"{c}_month": F.month(t).cast("double"),
            f"{c}_day": F.dayofmonth(t).cast("double"), f"{c}_dayofweek": F.weekday(t).cast("double"),
            f"{c}_is_weekend": is_weekend(t).cast("double")}).drop(c)
    if numbers:
        _, wide = wide_facts(df.select(*[col(c) for c in numbers]))
        skewed = [c for c in numbers if wide[c]["min"] is not None and wide[c]["min"] >= 0
                  and wide[c]["skew"] is not None and abs(wide[c]["skew"]) > 1.2]
        unique = value_facts(df, skewed)
        out = out.withColumns({f"{c}_log1p": F.log1p(number(df, c)) for c in skewed if unique[c]["unique"] > 10})
    if len(numbers) >= 2:
        a, b = numbers[:2]
        out = out.withColumn(f"{a}_div_{b}", number(df, a) / (F.abs(number(df, b)) + 1e-5))
    return out
