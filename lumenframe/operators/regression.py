"""Least squares from one pass of co-moments, and logistic regression."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from lumenframe.functions import dist
from lumenframe.functions.columns import col, number, require


class Fit(NamedTuple):
    coefficients: DataFrame
    summary: DataFrame


def _complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require(df, names)
    return df.select(*[number(df, c).alias(c) for c in names]).dropna()


def ols(df: DataFrame, target: str, features: Sequence[str]) -> Fit:
    """Coefficients with VIF, standard error, t and p; R2, F and residual spread.

    One aggregate gives all means and covariances; only that p-by-p matrix is solved here.
    """
    names = [target, *features]
    rows = _complete(df, names)
    pairs = list(combinations(range(len(names)), 2))
    row = rows.agg(F.count(F.lit(1)), *[F.avg(col(c)) for c in names], *[F.var_samp(col(c)) for c in names],
                   *[F.covar_samp(col(names[i]), col(names[j])) for i, j in pairs]).first()
    n, k, p = row[0], len(names), len(features)
    if n < p + 5:
        raise ValueError("too few complete rows")
    means = np.array(row[1:1 + k], dtype=float)
    cov = np.diag(np.array(row[1 + k:1 + 2 * k], dtype=float))
    for (i, j), v in zip(pairs, row[1 + 2 * k:]):
        cov[i, j] = cov[j, i] = v
    xx, xy, total = cov[1:, 1:], cov[1:, 0], cov[0, 0] * (n - 1)
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    intercept = means[0] - means[1:] @ beta
    residual = max(0.0, total - (n - 1) * float(beta @ xy))
    r2 = float(1 - residual / total) if total > 0 else 0.0
    adjusted = 1 - (1 - r2) * (n - 1) / (n - p - 1)
    sd = np.sqrt(np.diag(xx))
    inverse = np.linalg.pinv(xx / np.outer(sd, sd))
    vif = [float(min(999.0, v)) if v < 1000 else 999.0 for v in np.diag(inverse)]
    sigma2 = float(residual) / (n - p - 1)
    errors = np.sqrt(np.clip(sigma2 * np.diag(inverse) / (sd * sd * (n - 1)), 0, None))
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(f, float(b), v, "Severe" if v > 10 else "Moderate" if v > 5 else "Low", float(e))
         for f, b, v, e in zip(features, beta, vif, errors)],
        "feature string, coefficient double, vif double, multicollinearity string, std_error double")
    t = F.try_divide(F.col("coefficient"), F.col("std_error"))
    coefficients = table.withColumns({"t": t, "p_value": dist.t_two_sided(t, F.lit(n - p - 1))})
    f = (r2 / p) / ((1 - r2) / (n - p - 1)) if r2 < 1 else None
    summary = spark.createDataFrame(
        [(target, n, r2, adjusted, float(np.sqrt(residual / n)), float(intercept), 0.0, float(np.sqrt(residual / n)), f)],
        "target string, n long, r2 double, adjusted_r2 double, rmse double, intercept double, "
        "residual_mean double, residual_std double, f_statistic double")
    return Fit(coefficients, summary.withColumn("f_p_value", dist.f_upper(F.col("f_statistic"), F.lit(p), F.lit(n - p - 1))))


def polynomial_terms(df: DataFrame, columns: Sequence[str], degree: int = 2) -> tuple[DataFrame, list[str]]:
    """Powers and products up to a degree, named ``a_pow_2`` and ``a_b``."""
    terms: dict[str, object] = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            name = "_".join(c if combo.count(c) == 1 else f"{c}_pow_{combo.count(c)}" for c in dict.fromkeys(combo))
            value = number(df, combo[0])
            for c in combo[1:]:
                value = value * number(df, c)
            terms[name] = value
    return df.withColumns(terms), [*columns, *terms]


def polynomial_ols(df: DataFrame, target: str, features: Sequence[str], degree: int = 2) -> Fit:
    """Least squares on the features, their powers and products."""
    wide, names = polynomial_terms(df, features, degree)
    return ols(wide, target, names)


def logistic(df: DataFrame, target: str, features: Sequence[str], c: float = 1.0, max_iter: int = 1000) -> Fit:
    """L2 logistic regression with strength C on unscaled features, and its training accuracy."""
    rows = _complete(df, [target, *features])
    packed = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows).select(
        "features", col(target).alias("label"))
    n = packed.count()
    model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
                               maxIter=max_iter, tol=1e-8).fit(packed)
    hits = model.transform(packed).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    spark = df.sparkSession
    return Fit(spark.createDataFrame([(f, float(b)) for f, b in zip(features, model.coefficients)],
                                     "feature string, coefficient double"),
               spark.createDataFrame([(target, n, hits, float(model.intercept))],
                                     "target string, n long, accuracy double, intercept double"))
