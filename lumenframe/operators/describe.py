"""Descriptive statistics, answers about a column, density and Q-Q curves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions import dist
from lumenframe.functions.columns import col, is_missing, number, numeric_columns, string_columns
from lumenframe.operators.profile import modes, unbiased_kurtosis, unbiased_skew, value_facts
from lumenframe.operators.quantiles import column_quantiles


def shape_label(skew: float, kurt: float) -> str:
    if abs(skew) < 0.5 and abs(kurt) < 1.0:
        return "Approximately Normal"
    if skew > 1.0:
        return "Right-Skewed (Positive)"
    if skew < -1.0:
        return "Left-Skewed (Negative)"
    return "Heavy-Tailed (Leptokurtic)" if kurt > 2.0 else "Moderately Skewed"


def _moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    exprs = []
    for i, c in enumerate(columns):
        v = number(df, c)
        exprs += [F.count(v).alias(f"n{i}"), F.count_if(v.isNull()).alias(f"missing{i}"), F.avg(v).alias(f"mean{i}"),
                  F.stddev_samp(v).alias(f"std{i}"), F.var_samp(v).alias(f"var{i}"), F.min(v).alias(f"min{i}"),
                  F.max(v).alias(f"max{i}"), F.sum(v).alias(f"sum{i}"),
                  unbiased_skew(F.count(v), F.skewness(v)).alias(f"skew{i}"),
                  unbiased_kurtosis(F.count(v), F.kurtosis(v)).alias(f"kurt{i}"),
                  F.skewness(v).alias(f"g1{i}"), F.kurtosis(v).alias(f"g2{i}")]
    row = df.agg(*exprs).first()
    names = ["n", "missing", "mean", "std", "var", "min", "max", "sum", "skew", "kurt", "g1", "g2"]
    return {c: {k: row[f"{k}{i}"] for k in names} for i, c in enumerate(columns)}


SUMMARY_SCHEMA = ("feature string, n long, missing long, missing_pct double, mean double, std double, variance double, "
                  "min double, p25 double, p50 double, p75 double, p90 double, p99 double, max double, iqr double, "
                  "skewness double, kurtosis double, shape string")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
    quantiles = column_quantiles(df, columns, [0.25, 0.5, 0.75, 0.9, 0.99])
    out = []
    for c, m in _moments(df, columns).items():
        if not m["n"]:
            continue
        q = quantiles[c]
        skew, kurt = m["skew"] or 0.0, m["kurt"] or 0.0
        out.append((c, m["n"], m["missing"], 100.0 * m["missing"] / (m["n"] + m["missing"]), m["mean"],
                    m["std"] or 0.0, m["var"] or 0.0, m["min"], *q, m["max"], q[2] - q[0], skew, kurt,
                    shape_label(skew, kurt)))
    return df.sparkSession.createDataFrame(out, SUMMARY_SCHEMA)


CATEGORY_SCHEMA = ("feature string, n long, missing long, missing_pct double, unique_values long, top_category string, "
                   "top_frequency long, top_pct double, rare_categories long")


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, rare_below: float = 0.02) -> DataFrame:
    """One row per text column: distinct values, top value, values below 2 % of the rows."""
    columns = list(columns) if columns is not None else string_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], CATEGORY_SCHEMA)
    row = df.agg(F.count(F.lit(1)), *[F.count_if(is_missing(df, c)) for c in columns]).first()
    out = []
    for (c, f), missing in zip(value_facts(df, columns, rare_below).items(), row[1:]):
        n = row[0] - missing
        if n:
            out.append((c, n, missing, 100.0 * missing / row[0], f["unique"], f["top"], f["top_n"],
                        100.0 * f["top_n"] / n, f["rare"]))
    return df.sparkSession.createDataFrame(out, CATEGORY_SCHEMA)


def k2_pvalue(n: Column, g1: Column, g2: Column) -> Column:
    """D'Agostino-Pearson omnibus p-value from population skewness and excess kurtosis; null under 20 rows."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    z1 = F.asinh(y / F.sqrt(F.lit(2.0) / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))
    mean = 3.0 * (n - 1) / (n + 1)
    variance = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(variance)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1 + 4.0 / (root * root)))
    base = (1 - 2.0 / a) / (1 + x * F.sqrt(2.0 / (a - 4.0)))
    cube = F.signum(base) * F.pow(F.abs(base), F.lit(1.0 / 3))
    z2 = (1 - 2.0 / (9.0 * a) - cube) / F.sqrt(2.0 / (9.0 * a))
    return F.when(n >= 20, F.exp(-(z1 * z1 + z2 * z2) / 2))


def descriptive(df: DataFrame, column: str) -> DataFrame:
    """One row: moments, quantiles, mode, t interval of the mean, normality (null under 20 rows)."""
    m = _moments(df, [column])[column]
    if m["n"] < 3:
        raise ValueError("at least three values are needed")
    q = column_quantiles(df, [column], [0.1, 0.25, 0.5, 0.75, 0.9])[column]
    row = df.sparkSession.createDataFrame(
        [(column, m["n"], m["mean"], q[2], modes(df, [column])[column], m["std"], m["var"], m["skew"], m["kurt"],
          m["min"], *q, m["max"], q[3] - q[1], m["g1"], m["g2"])],
        "column string, n long, mean double, median double, mode double, std double, variance double, "
        "skewness double, kurtosis double, min double, p10 double, q25 double, q50 double, q75 double, p90 double, "
        "max double, iqr double, g1 double, g2 double")
    se = F.col("std") / F.sqrt(F.col("n").cast("double"))
    reach = dist.t_ppf(0.975, F.col("n") - 1) * se
    out = row.withColumns({"std_error": se, "reach": reach, "normality_p": k2_pvalue(F.col("n"), F.col("g1"), F.col("g2"))})
    return out.withColumns({"ci_low": F.col("mean") - F.col("reach"), "ci_high": F.col("mean") + F.col("reach"),
                            "is_normal": F.col("normality_p") > 0.05}).drop("reach", "g1", "g2")


def column_answers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: mean, median, range, peak over mean, sum, spread, 95th percentile, rows above it."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    moments = _moments(df, columns)
    quantiles = column_quantiles(df, columns, [0.25, 0.5, 0.75, 0.95])
    above = df.agg(*[F.count_if(number(df, c) > F.lit(quantiles[c][3])) for c in columns]).first()
    out = []
    for c, n_above in zip(columns, above):
        m, q = moments[c], quantiles[c]
        if m["n"]:
            out.append((c, m["n"], m["missing"], m["mean"], q[1], m["min"], m["max"], m["max"] / (m["mean"] or 1.0),
                        m["sum"], m["std"], q[0], q[2] - q[0], q[3], n_above))
    return df.sparkSession.createDataFrame(
        out, "column string, n long, missing long, mean double, median double, min double, max double, "
             "peak_ratio double, total double, std double, q25 double, iqr double, p95 double, above_p95 long")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line through the points: slope, intercept, r2."""
    a, b = number(df, x), number(df, y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"),
                  F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def qq_points(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Sample quantiles on a grid of probabilities against normal ones, with the fitted line."""
    probs = [(i + 0.5) / points for i in range(points)]
    sample = np.array(column_quantiles(df, [column], probs)[column], dtype=float)
    theory = np.array([dist.norm_ppf_value(p) for p in probs])
    slope, intercept = np.polyfit(theory, sample, 1)
    rows = [(i + 1, p, float(t), float(s), float(slope * t + intercept))
            for i, (p, t, s) in enumerate(zip(probs, theory, sample))]
    return df.sparkSession.createDataFrame(
        rows, "point int, prob double, theoretical double, sample double, line double")


def density(df: DataFrame, column: str, points: int | None = None, by: str | None = None,
            groups: Sequence | None = None) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid from min to max.

    Every task adds its values into one row of sums per group, so only grid-sized partial
    sums are shuffled. With ``by``, name the groups to draw.
    """
    points = points or (150 if by else 200)
    value = number(df, column).alias("v")
    rows = df.select((col(by).cast("string") if by else F.lit("all")).alias("g"), value).where("v is not null")
    if by and groups is not None:
        rows = rows.where(F.col("g").isin([str(g) for g in groups]))
    facts = {r["g"]: r for r in rows.groupBy("g").agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")
    ).where("n > 5 and sd > 0").collect()}
    if not facts:
        return df.sparkSession.createDataFrame([], "g string, x double, density double")
    grids = {g: (np.linspace(r["lo"], r["hi"], points), r["sd"] * r["n"] ** -0.2, r["n"]) for g, r in facts.items()}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {g: np.zeros(points) for g in grids}
        for batch in batches:
            for g, part in batch.groupby("g"):
                if g in grids:
                    grid, h, _ = grids[g]
                    x, weight = part["v"].to_numpy(), part["n"].to_numpy()
                    for i, at in enumerate(grid):
                        sums[g][i] += (weight * np.exp(-0.5 * ((at - x) / h) ** 2)).sum()
        for g, total in sums.items():
            yield pd.DataFrame({"g": g, "i": np.arange(points), "s": total})

    folded = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    summed = folded.mapInPandas(partial, "g string, i int, s double").groupBy("g", "i").agg(F.sum("s").alias("s"))
    scale = [(g, i, float(grid[i]), float(1 / (n * h * np.sqrt(2 * np.pi))))
             for g, (grid, h, n) in grids.items() for i in range(points)]
    spine = df.sparkSession.createDataFrame(scale, "g string, i int, x double, scale double")
    return spine.join(F.broadcast(summed), ["g", "i"]).select(
        "g", "x", (F.col("s") * F.col("scale")).alias("density"))
