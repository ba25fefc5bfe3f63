"""Column profiles, roles and health scores from a fixed number of passes.

Pass 1 is one wide aggregate, pass 2 folds every column's values to counts (distinct
values, top value, rare values), pass 3 counts values outside literal fences.
What comes back to the driver is one row per column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumenframe.functions.columns import (
    col, is_missing, is_numeric, is_text, normalise_missing, number, numeric_columns, string_columns, time_columns)
from lumenframe.operators.quantiles import column_quantiles

# Name parts that mark roles.
DATE_WORDS = ["date", "timestamp", "time", "created_at", "updated_at", "signup"]
NUMERIC_ID_WORDS = ["_id", "id", "code", "zip", "postal"]
TEXT_ID_WORDS = ["id", "uuid", "guid", "key", "code"]
TARGET_WORDS = ["target", "label", "churn", "price", "revenue", "sales", "converted", "fraud",
                "outcome", "status", "class"]
BOOLEAN_TEXT = {"0", "1", "True", "False", "true", "false", "Yes", "No", "yes", "no"}
ISO_START = re.compile(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}")


def unbiased_skew(n: Column, g1: Column) -> Column:
    """Bias-corrected skewness from the population one; null below three rows."""
    n = n.cast("double")
    return F.when((n > 2) & ~F.isnan(g1), g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def unbiased_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four rows."""
    n = n.cast("double")
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when((n > 3) & ~F.isnan(g2), scale * ((n + 1) * g2 + 6))


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): every column's non-null values as text, folded to counts."""
    clean = normalise_missing(df.select(*[col(c) for c in columns]))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    long = clean.select(F.explode(pairs).alias("x")).select("x.column", "x.value").where("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def value_facts(df: DataFrame, columns: Sequence[str], rare_below: float | None = None) -> dict[str, dict]:
    """Distinct count, largest count and, for text, the top and rare values; one row per column to the driver.

    Values keep their type (number columns are not turned into text), all columns in one scan.
    """
    out: dict[str, dict] = {c: {"column": c, "unique": 0, "top_n": 0, "top": None, "rare": 0} for c in columns}
    if not columns:
        return out

    def typed(c: str) -> list[Column]:
        kind = df.schema[c].dataType
        whole, real = isinstance(kind, T.IntegralType), isinstance(kind, (T.DoubleType, T.FloatType))
        return [col(c).cast("bigint") if whole else F.lit(None).cast("bigint"), col(c).cast("double") if real else F.lit(None).cast("double"),
                F.lit(None).cast("string") if whole or real else col(c).cast("string")]

    clean = normalise_missing(df.select(*[col(c) for c in columns]))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), *[v.alias(n) for v, n in zip(typed(c), ("w", "r", "t"))])
                      for i, c in enumerate(columns)])
    long = clean.select(F.explode(cells).alias("x")).select("x.*").where("w is not null or r is not null or t is not null")
    folded = long.groupBy("i", "w", "r", "t").agg(F.count(F.lit(1)).alias("n"))
    facts = [F.count(F.lit(1)).alias("unique"), F.max("n").alias("top_n"),
             F.min_by("t", F.struct((-F.col("n")).alias("m"), F.col("t"))).alias("top")]
    if rare_below is not None:
        known = df.agg(*[F.count_if(~is_missing(df, c)) for c in columns]).first()
        limits = F.array(*[F.lit(rare_below * n) for n in known])
        facts.append(F.count_if(F.col("n") < F.element_at(limits, F.col("i") + 1)).alias("rare"))
    for r in folded.groupBy("i").agg(*facts).collect():
        out[columns[r["i"]]] |= {k: v for k, v in r.asDict().items() if k != "i"}
    return out


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column (smallest on ties), null where a column is empty."""
    out: dict[str, object] = {}
    texts = [c for c in columns if not is_numeric(df, c)]
    numbers = [c for c in columns if is_numeric(df, c)]
    out.update({c: f["top"] for c, f in value_facts(df, texts).items()})
    if numbers:
        values = df.select(*[number(df, c).alias(c) for c in numbers])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in numbers])
        counts = (values.select(F.explode(pairs).alias("x")).select("x.column", "x.value")
                  .where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        tops = counts.groupBy("column").agg(
            F.min_by("value", F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("top")).collect()
        out.update({c: None for c in numbers} | {r["column"]: r["top"] for r in tops})
    return out


def wide_facts(df: DataFrame) -> tuple[int, dict[str, dict]]:
    """Row count and, per column, missing count and moments: one aggregate."""
    numbers = numeric_columns(df)
    # Values are projected once, so the many aggregates read plain columns.
    plain = df.select(*[(number(df, c) if c in numbers else F.when(is_missing(df, c), F.lit(None)).otherwise(F.lit(1))).alias(f"c{i}")
                        for i, c in enumerate(df.columns)])
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        v = F.col(f"c{i}")
        exprs.append(F.count_if(v.isNull()).alias(f"m{i}"))
        if c in numbers:
            exprs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"av{i}"),
                      F.stddev_samp(v).alias(f"sd{i}"), unbiased_skew(F.count(v), F.skewness(v)).alias(f"sk{i}")]
    row = plain.agg(*exprs).first()
    out = {}
    for i, c in enumerate(df.columns):
        facts = {"missing": row[f"m{i}"]}
        if c in numbers:
            facts |= {"min": row[f"lo{i}"], "max": row[f"hi{i}"], "mean": row[f"av{i}"],
                      "std": row[f"sd{i}"], "skew": row[f"sk{i}"]}
        out[c] = facts
    return row["rows"], out


def outside_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Values outside literal bounds, all columns in one aggregate."""
    if not bounds:
        return {}
    row = df.agg(*[F.count_if((number(df, c) < lo) | (number(df, c) > hi)) for c, (lo, hi) in bounds.items()]).first()
    return dict(zip(bounds, row))


def read_as_dates(df: DataFrame, columns: dict[str, bool]) -> set[str]:
    """The text columns whose values all parse as dates, in one aggregate; a column that is not named like
    a date (False) must also start every value with year, month and day."""
    columns = {c: named for c, named in columns.items() if is_text(df, c)}
    if not columns:
        return set()
    exprs = []
    for c, named in columns.items():
        good = F.try_to_timestamp(F.replace(col(c), F.lit("/"), F.lit("-"))).isNotNull()
        # Short of the start of a date nothing is parsed.
        good = good if named else F.when(col(c).rlike(ISO_START.pattern), good).otherwise(False)
        exprs.append((F.count(col(c)) > 0) & (F.count_if(col(c).isNotNull() & ~good) == 0))
    return {c for c, dates in zip(columns, df.agg(*exprs).first()) if dates}


def column_facts(df: DataFrame) -> tuple[int, dict[str, dict]]:
    rows, facts = wide_facts(df)
    numbers = numeric_columns(df)
    for c, f in value_facts(df, df.columns).items():
        facts[c] |= {"unique": f["unique"], "top": f["top"], "top_n": f["top_n"]}
    quartiles = column_quantiles(df, numbers, [0.25, 0.5, 0.75])
    for c, (q1, q2, q3) in quartiles.items():
        facts[c] |= {"q25": q1, "median": q2, "q75": q3}
    return rows, facts


def _role(df: DataFrame, name: str, unique: int, unique_pct: float, dates: set[str]) -> str:
    low, kind = name.lower(), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if name in time_columns(df) or name in dates:
        return "datetime"
    if is_numeric(df, name):
        if unique <= 2:
            return "boolean"
        if any(w in low for w in NUMERIC_ID_WORDS) and unique_pct > 80:
            return "id"
        return "categorical" if unique < 12 and unique_pct < 5 else "numeric"
    if any(w in low for w in TEXT_ID_WORDS) and unique_pct > 70:
        return "id"
    return "categorical" if unique <= 20 or (unique_pct < 10 and unique < 50) else "text"


PROFILE_SCHEMA = ("column string, dtype string, role string, null_count long, null_pct double, unique_count long, "
                  "unique_pct double, is_target_candidate boolean, min double, max double, mean double, "
                  "median double, std double, q25 double, q75 double, outlier_count long, top_category string, "
                  "top_category_freq long")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: role, missing, distinct, moments, quartiles, 1.5-IQR outliers, top category."""
    rows, facts = column_facts(df)
    bounds = {c: (f["q25"] - 1.5 * (f["q75"] - f["q25"]), f["q75"] + 1.5 * (f["q75"] - f["q25"]))
              for c, f in facts.items() if f.get("q25") is not None}
    outliers = outside_counts(df, bounds)
    dates = read_as_dates(df, {c: any(w in c.lower() for w in DATE_WORDS) for c in df.columns})
    out = []
    for c, f in facts.items():
        pct = 100.0 * f["unique"] / rows if rows else 0.0
        role = _role(df, c, f["unique"], round(pct, 2), dates)
        top = role == "categorical" and not is_numeric(df, c)
        out.append((c, df.schema[c].dataType.simpleString(), role, f["missing"],
                    100.0 * f["missing"] / rows if rows else 0.0, f["unique"], pct,
                    any(w in c.lower() for w in TARGET_WORDS), f.get("min"), f.get("max"), f.get("mean"),
                    f.get("median"), f.get("std"), f.get("q25"), f.get("q75"), outliers.get(c),
                    f["top"] if top else None, f["top_n"] if top else None))
    return df.sparkSession.createDataFrame(out, PROFILE_SCHEMA)


def feature_categories(df: DataFrame) -> dict[str, list[str]]:
    """numerical, categorical_low (at most 10 values), categorical_high, datetime, text_or_id."""
    rows = df.count()
    unique = {c: f["unique"] for c, f in value_facts(df, df.columns).items()}
    out: dict[str, list[str]] = {k: [] for k in
                                 ("numerical", "categorical_low", "categorical_high", "datetime", "text_or_id")}
    dates = read_as_dates(df, {c: "date" in c.lower() or "time" in c.lower() for c in df.columns})
    for c in df.columns:
        if c in time_columns(df) or c in dates:
            out["datetime"].append(c)
        elif is_numeric(df, c):
            whole = isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType))
            out["text_or_id" if whole and rows > 50 and unique[c] == rows else "numerical"].append(c)
        elif rows and unique[c] / rows > 0.85 and unique[c] > 50:
            out["text_or_id"].append(c)
        else:
            out["categorical_low" if unique[c] <= 10 else "categorical_high"].append(c)
    return out


def automl_types(df: DataFrame, target: str) -> dict[str, list[str]]:
    """Column kinds used by the model-selection run; null counts as a value here."""
    features = [c for c in df.columns if c != target]
    rows, wide = wide_facts(df.select(*[col(c) for c in features]))
    facts = value_facts(df, features)
    out: dict[str, list[str]] = {k: [] for k in (
        "numeric_continuous", "numeric_discrete", "categorical_low", "categorical_high",
        "datetime", "boolean", "id_or_constant")}
    two = [c for c in features if facts[c]["unique"] == 2 and not wide[c]["missing"]]
    pairs: dict[str, set] = {c: set() for c in two}
    if two:
        for r in value_table(df, two).select("column", "value").collect():
            pairs[r["column"]].add(r["value"][:-2] if r["value"].endswith(".0") else r["value"])
    dates = read_as_dates(df, {c: True for c in features if any(w in c.lower() for w in ["date", "time", "timestamp", "created", "updated"])})
    for c in features:
        low, unique = c.lower(), facts[c]["unique"] + (1 if wide[c]["missing"] else 0)
        id_word = any(w in low for w in ["id", "code", "uuid", "key", "guid"])
        if unique <= 1 or (unique == rows and rows >= 10 and (not is_numeric(df, c) or id_word)):
            kind = "id_or_constant"
        elif c in time_columns(df) or c in dates:
            kind = "datetime"
        elif isinstance(df.schema[c].dataType, T.BooleanType) or (c in pairs and pairs[c] <= BOOLEAN_TEXT):
            kind = "boolean"
        elif is_numeric(df, c):
            real = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
            kind = "numeric_discrete" if unique <= 10 and not real else "numeric_continuous"
        else:
            kind = "categorical_low" if unique <= 15 else "categorical_high"
        out[kind].append(c)
    return out


def as_table(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(category, column) rows of a column classification."""
    return df.sparkSession.createDataFrame([(g, c) for g, cs in groups.items() for c in cs],
                                           "category string, column string")


def duplicate_rows(df: DataFrame) -> int:
    """Rows beyond the first of each full-row copy; copies are folded before the shuffle."""
    clean = normalise_missing(df)
    copies = clean.groupBy(*[col(c) for c in clean.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return copies.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one value, null counting as a value: min and max decide, no distinct count."""
    exprs = []
    for c in df.columns:
        v = col(c).cast("string") if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else col(c)
        missing = F.count_if(is_missing(df, c))
        exprs.append((missing == F.count(F.lit(1))) | ((missing == 0) & F.min(v).eqNullSafe(F.max(v))))
    row = df.agg(*exprs).first()
    return [c for c, constant in zip(df.columns, row) if constant]


def grade(score: float) -> str:
    return "A" if score >= 90 else "B" if score >= 75 else "C" if score >= 60 else "D"


HEALTH_SCHEMA = ("health_score int, grade string, missing_cells long, missing_pct double, duplicated_rows long, "
                 "duplicated_pct double, constant_columns array<string>, outlier_cells long, outlier_pct double")


def health_score(df: DataFrame) -> DataFrame:
    """0-100 with penalties for missing cells, duplicate rows, constant columns, extreme values (2.5 IQR)."""
    rows, facts = wide_facts(df)
    cells = rows * len(df.columns)
    missing = sum(f["missing"] for f in facts.values())
    missing_pct = round(100.0 * missing / cells, 2) if cells else 0.0
    duplicates = duplicate_rows(df)
    dup_pct = round(100.0 * duplicates / rows, 2) if rows else 0.0
    constant = constant_columns(df)
    usable = [c for c in numeric_columns(df) if rows - facts[c]["missing"] > 10]
    bounds = {c: (a - 2.5 * (b - a), b + 2.5 * (b - a))
              for c, (a, b) in column_quantiles(df, usable, [0.25, 0.75]).items() if b > a}
    outliers = sum(outside_counts(df, bounds).values())
    outlier_pct = round(100.0 * outliers / cells, 2) if cells else 0.0
    score = 100.0 - min(35.0, missing_pct * 1.5) - min(20.0, dup_pct * 2.0) - min(15.0, len(constant) * 5.0)
    if outlier_pct > 0.5:
        score -= min(15.0, outlier_pct * 2.5)
    final = int(min(100, max(0, round(score))))
    return df.sparkSession.createDataFrame(
        [(final, grade(final), missing, missing_pct, duplicates, dup_pct, constant, outliers, outlier_pct)],
        HEALTH_SCHEMA)


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent."""
    rows, facts = wide_facts(df)
    return df.sparkSession.createDataFrame(
        [(c, f["missing"], 100.0 * f["missing"] / rows) for c, f in facts.items() if f["missing"]],
        "column string, missing_count long, missing_pct double")


def padded_text(df: DataFrame) -> DataFrame:
    """Text columns with values that begin or end with a space, and how many."""
    texts = string_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, padded long")
    row = df.agg(*[F.count_if(col(c).startswith(" ") | col(c).endswith(" ")) for c in texts]).first()
    return df.sparkSession.createDataFrame([(c, n) for c, n in zip(texts, row) if n], "column string, padded long")


OUTLIER_SCHEMA = ("column string, iqr_outliers long, iqr_pct double, lower_bound double, upper_bound double, "
                  "z_score_outliers long")


def outlier_table(df: DataFrame) -> DataFrame:
    """Numeric columns (five values or more) with values outside 1.5 IQR or three deviations."""
    rows, facts = wide_facts(df)
    usable = [c for c in numeric_columns(df) if rows - facts[c]["missing"] >= 5]
    iqr = {c: (a - 1.5 * (b - a), b + 1.5 * (b - a))
           for c, (a, b) in column_quantiles(df, usable, [0.25, 0.75]).items()}
    z = {c: (facts[c]["mean"] - 3 * facts[c]["std"], facts[c]["mean"] + 3 * facts[c]["std"])
         for c in usable if facts[c]["std"]}
    by_iqr, by_z = outside_counts(df, iqr), outside_counts(df, z)
    out = [(c, by_iqr[c], 100.0 * by_iqr[c] / (rows - facts[c]["missing"]), *iqr[c], by_z.get(c, 0))
           for c in usable if by_iqr[c] or by_z.get(c)]
    return df.sparkSession.createDataFrame(out, OUTLIER_SCHEMA)


def upper_outliers(df: DataFrame) -> DataFrame:
    """Values above the upper fence q75 + 1.5 IQR per numeric column."""
    fences = {c: b + 1.5 * (b - a) for c, (a, b) in
              column_quantiles(df, numeric_columns(df), [0.25, 0.75]).items() if a is not None}
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, fence double, above long")
    row = df.agg(*[F.count_if(number(df, c) > f) for c, f in fences.items()]).first()
    return df.sparkSession.createDataFrame([(c, f, n) for (c, f), n in zip(fences.items(), row)],
                                           "column string, fence double, above long")


def audit_quality(df: DataFrame) -> dict[str, DataFrame]:
    """missing, outliers, padded and a one-row summary with its own quality score (floor 5)."""
    rows = df.count()
    missing, outliers, padded = missing_table(df), outlier_table(df), padded_text(df)
    duplicates, constant, numbers = duplicate_rows(df), constant_columns(df), numeric_columns(df)
    missing_cells = missing.agg(F.coalesce(F.sum("missing_count"), F.lit(0))).first()[0]
    outlying = outliers.agg(F.coalesce(F.sum("iqr_outliers"), F.lit(0))).first()[0]
    dup_pct = round(100.0 * duplicates / rows, 2) if rows else 0.0
    score = 0
    if rows and df.columns:
        value = 100.0 - min(40, 150 * missing_cells / (rows * len(df.columns))) - min(25, dup_pct * 2.5)
        value -= min(15, 5 * len(constant)) + (min(15, 100 * outlying / (rows * len(numbers))) if numbers else 0)
        score = max(5, int(round(value)))
    summary = df.sparkSession.createDataFrame(
        [(rows, len(df.columns), missing_cells, duplicates, dup_pct, constant,
          [r[0] for r in padded.select("column").collect()], score)],
        "rows long, columns int, missing_cells long, duplicate_rows long, duplicate_pct double, "
        "constant_columns array<string>, padded_columns array<string>, quality_score int")
    return {"missing": missing, "outliers": outliers, "padded": padded, "summary": summary}


def overview_score(df: DataFrame) -> DataFrame:
    """100 - 120 x missing share - 80 x duplicate share, at least 10."""
    rows, facts = wide_facts(df)
    missing, duplicates = sum(f["missing"] for f in facts.values()), duplicate_rows(df)
    cells = max(1, rows * len(df.columns))
    score = max(10, int(round(100 - 120 * missing / cells - 80 * duplicates / max(1, rows))))
    return df.sparkSession.createDataFrame([(rows, len(df.columns), missing, duplicates, score)],
                                           "rows long, columns int, missing_cells long, duplicate_rows long, score int")


def quick_profile(df: DataFrame) -> DataFrame:
    """Shape, number of columns per role, health score and grade: one row."""
    roles = profile(df).groupBy("role").count().collect()
    counts = {r["role"]: r["count"] for r in roles}
    health = health_score(df)
    names = ["boolean", "categorical", "datetime", "id", "numeric", "text"]
    return health.select(F.lit(df.count()).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                         *[F.lit(counts.get(n, 0)).alias(f"{n}_columns") for n in names],
                         "health_score", "grade", "missing_cells", "duplicated_rows")


def id_columns(df: DataFrame) -> list[str]:
    """Columns in which every row has its own value."""
    rows = df.count()
    return [c for c, f in value_facts(df, df.columns).items() if rows and f["unique"] == rows]
