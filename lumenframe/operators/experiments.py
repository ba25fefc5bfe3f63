"""Two-arm experiments, any number of them at once.

Every formula is a column over one row per experiment; ``segments`` names the columns
that tell experiments apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions import dist
from lumenframe.functions.columns import col, is_numeric, number, safe_div
from lumenframe.functions.text import strip

# Texts that mean converted, the normal quantile of 80 % power, bounds of the power estimate.
CONVERTED = ["1", "true", "yes", "y", "converted", "success"]
Z_80 = 0.8416
POWER_RANGE = (0.05, 0.999)


def _winner(p: Column, diff: Column, alpha: float) -> Column:
    return F.when(p > alpha, "inconclusive").when(diff > 0, "treatment").otherwise("control")


def _power(x: Column) -> Column:
    return F.greatest(F.lit(POWER_RANGE[0]), F.least(F.lit(POWER_RANGE[1]), dist.norm_cdf(x)))


def _p(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1.0), p))


def conversion_test(df: DataFrame, arm: str, control, treatment, target: str, segments: Sequence[str] = (),
                    confidence: float = 0.95, min_rows: int = 10) -> DataFrame:
    """Pooled two-proportion z test with interval, lift, effect sizes, power and required size.

    Numbers above 0 and the usual yes-texts count as converted. Experiments with fewer than
    ten rows in an arm are left out.
    """
    c = col(target)
    if is_numeric(df, target):
        hit = F.coalesce(c > 0, F.lit(False))
    else:
        hit = F.coalesce(F.lower(strip(c.cast("string"))).isin(CONVERTED), F.lit(False))
    is_c, is_t = col(arm) == F.lit(control), col(arm) == F.lit(treatment)
    keys = [col(s) for s in segments]
    g = df.where(is_c | is_t).groupBy(*keys).agg(
        F.count_if(is_c).alias("n_c"), F.count_if(is_t).alias("n_t"),
        F.count_if(is_c & hit).alias("x_c"), F.count_if(is_t & hit).alias("x_t"),
    ).where((F.col("n_c") >= min_rows) & (F.col("n_t") >= min_rows))
    alpha = 1 - confidence
    z_crit = dist.norm_ppf_value(1 - alpha / 2)
    g = g.withColumns({"p_c": F.col("x_c") / F.col("n_c"), "p_t": F.col("x_t") / F.col("n_t"),
                       "pool": (F.col("x_c") + F.col("x_t")) / (F.col("n_c") + F.col("n_t"))})
    p_c, p_t, pool = F.col("p_c"), F.col("p_t"), F.col("pool")
    se_pool = F.when((pool > 0) & (pool < 1), F.sqrt(pool * (1 - pool) * (1 / F.col("n_c") + 1 / F.col("n_t")))
                     ).otherwise(F.lit(1e-5))
    se = F.when((p_c > 0) | (p_t > 0), F.sqrt(p_c * (1 - p_c) / F.col("n_c") + p_t * (1 - p_t) / F.col("n_t"))
                ).otherwise(F.lit(1e-5))
    odds_c = F.when(p_c < 1, p_c / F.nullif(1 - p_c, F.lit(0.0))).otherwise(F.lit(999.0))
    odds_t = F.when(p_t < 1, p_t / F.nullif(1 - p_t, F.lit(0.0))).otherwise(F.lit(999.0))
    g = g.withColumns({
        "difference": p_t - p_c, "z": safe_div(p_t - p_c, se_pool), "se": se,
        "lift_pct": F.when(p_c > 0, (p_t - p_c) / F.nullif(p_c, F.lit(0.0)) * 100).otherwise(F.lit(0.0)),
        "cohen_h": F.abs(2 * F.asin(F.sqrt(p_t)) - 2 * F.asin(F.sqrt(p_c))),
        "relative_risk": F.when(p_c > 0, p_t / F.nullif(p_c, F.lit(0.0))).otherwise(F.lit(1.0)),
        "odds_ratio": F.when(odds_c > 0, odds_t / F.nullif(odds_c, F.lit(0.0))).otherwise(F.lit(1.0))})
    diff, h = F.col("difference"), F.col("cohen_h")
    needed = F.when(F.abs(diff) > 1e-4, F.ceil(2 * (z_crit + Z_80) ** 2 * pool * (1 - pool) / F.nullif(diff * diff, F.lit(0.0)))
                    ).otherwise(F.lit(50_000)).cast("long")
    g = g.withColumns({"p_value": _p(dist.norm_two_sided(F.col("z"))), "power": _power(F.abs("z") - z_crit),
                       "required_n": needed, "ci_low": diff - z_crit * F.col("se"), "ci_high": diff + z_crit * F.col("se"),
                       "magnitude": F.when(h < 0.2, "Small").when(h < 0.5, "Medium").otherwise("Large")})
    return g.select(*keys, "n_c", "n_t", "x_c", "x_t", "p_c", "p_t", "difference", "lift_pct", "z", "p_value",
                    "ci_low", "ci_high", "cohen_h", "magnitude", "relative_risk", "odds_ratio", "power", "required_n",
                    (F.col("p_value") <= alpha).alias("significant"), _winner(F.col("p_value"), diff, alpha).alias("winner"))


def mean_test(df: DataFrame, arm: str, control, treatment, metric: str, segments: Sequence[str] = (),
              confidence: float = 0.95, min_rows: int = 5) -> DataFrame:
    """Welch t test of two arms with interval, lift, Cohen's d, power and required size."""
    v = number(df, metric)
    a, b = F.when(col(arm) == F.lit(control), v), F.when(col(arm) == F.lit(treatment), v)
    keys = [col(s) for s in segments]
    g = df.groupBy(*keys).agg(
        F.count(a).alias("n_c"), F.count(b).alias("n_t"), F.avg(a).alias("mean_c"), F.avg(b).alias("mean_t"),
        F.stddev_samp(a).alias("std_c"), F.stddev_samp(b).alias("std_t"),
    ).where((F.col("n_c") >= min_rows) & (F.col("n_t") >= min_rows))
    alpha = 1 - confidence
    z_crit = dist.norm_ppf_value(1 - alpha / 2)
    n_c, n_t = F.col("n_c"), F.col("n_t")
    v_c, v_t = F.col("std_c") * F.col("std_c") / n_c, F.col("std_t") * F.col("std_t") / n_t
    diff = F.col("mean_t") - F.col("mean_c")
    pooled = F.sqrt(((n_c - 1) * F.col("std_c") * F.col("std_c") + (n_t - 1) * F.col("std_t") * F.col("std_t"))
                    / (n_c + n_t - 2))
    g = g.withColumns({
        "difference": diff, "se": F.sqrt(v_c + v_t),
        "lift_pct": F.when(F.abs("mean_c") > 1e-9, diff / F.nullif(F.col("mean_c"), F.lit(0.0)) * 100).otherwise(F.lit(0.0)),
        "t": safe_div(diff, F.sqrt(v_c + v_t)),
        "dof": F.coalesce(safe_div((v_c + v_t) * (v_c + v_t), v_c * v_c / (n_c - 1) + v_t * v_t / (n_t - 1)),
                          (n_c + n_t - 2).cast("double")),
        "cohen_d": F.coalesce(safe_div(F.abs(diff), pooled), F.lit(0.0))})
    d = F.col("cohen_d")
    needed = F.when(d > 0.005, F.ceil(2 * (z_crit + Z_80) ** 2 / F.nullif(d * d, F.lit(0.0)))).otherwise(F.lit(50_000))
    g = g.withColumns({
        "p_value": _p(dist.t_two_sided(F.col("t"), F.col("dof"))), "power": _power(F.abs("t") - z_crit),
        "reach": dist.t_ppf(1 - alpha / 2, F.col("dof")) * F.col("se"), "required_n": needed.cast("long"),
        "magnitude": F.when(d < 0.2, "Negligible").when(d < 0.5, "Small").when(d < 0.8, "Medium").otherwise("Large")})
    return g.select(*keys, "n_c", "n_t", "mean_c", "mean_t", "std_c", "std_t", "difference", "lift_pct", "t", "dof",
                    "p_value", (F.col("difference") - F.col("reach")).alias("ci_low"),
                    (F.col("difference") + F.col("reach")).alias("ci_high"), "cohen_d", "magnitude", "power", "required_n",
                    (F.col("p_value") <= alpha).alias("significant"),
                    _winner(F.col("p_value"), F.col("difference"), alpha).alias("winner"))


def required_size(baseline: DataFrame, value: str, mde_pct: float, kind: str = "conversion", std: str | None = None,
                  alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Rows per arm to see a relative change of ``mde_pct`` percent, for a table of baselines.

    ``value`` holds the baseline rate or mean; ``std`` the deviation (half the mean where missing).
    """
    z = dist.norm_ppf_value(1 - alpha / 2) + dist.norm_ppf_value(power)
    base = number(baseline, value)
    if kind == "conversion":
        expected = F.greatest(F.lit(1e-4), F.least(F.lit(0.9999), base * (1 + mde_pct / 100)))
        mid = (base + expected) / 2
        n = safe_div(2 * z * z * mid * (1 - mid), F.pow(expected - base, 2))
    elif kind == "mean":
        expected = base * (1 + mde_pct / 100)
        half = F.abs(base) * 0.5
        sd = F.when(number(baseline, std) > 0, number(baseline, std)).otherwise(half) if std else half
        n = safe_div(F.lit(2 * z * z), F.pow(safe_div(F.abs(base * mde_pct / 100), sd), 2))
    else:
        raise ValueError(f"unknown kind: {kind}")
    return baseline.withColumns({"expected": expected, "n_per_arm": F.ceil(n).cast("long")}).withColumn(
        "total_n", F.col("n_per_arm") * 2)
