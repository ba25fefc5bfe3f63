"""Tail probabilities and quantiles of the usual distributions.

Spark SQL has no normal, t, F or chi-square distribution. These are Arrow batch
functions for *aggregated* rows (one row per group or test), never for raw rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_NORMAL = NormalDist()


def _norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + even * d) or tiny)
        c = (1 + even / c) or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + odd * d) or tiny)
        c = (1 + odd / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def norm_ppf_value(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _t_two_sided(t: float, df: float) -> float:
    return _beta_inc(df / 2, 0.5, df / (df + t * t))


def _t_ppf(p: float, df: float) -> float:
    """Quantile by bisection on the two-sided tail."""
    if p == 0.5:
        return 0.0
    tail, low, high = 2 * min(p, 1 - p), 0.0, 1.0
    while _t_two_sided(high, df) > tail and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if _t_two_sided(mid, df) > tail:
            low = mid
        else:
            high = mid
    return math.copysign((low + high) / 2, p - 0.5)


def _f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else _beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _batch(fn, *series: pd.Series) -> pd.Series:
    out = np.full(len(series[0]), np.nan)
    for i, args in enumerate(zip(*(s.to_numpy(dtype=float, na_value=np.nan) for s in series))):
        if not any(math.isnan(a) for a in args):
            out[i] = fn(*args)
    return pd.Series(out, dtype="float64").where(~np.isnan(out), None)


@F.pandas_udf(T.DoubleType())
def _u_norm_cdf(x: pd.Series) -> pd.Series:
    return _batch(_norm_cdf, x)


@F.pandas_udf(T.DoubleType())
def _u_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _batch(lambda a, b: _t_two_sided(a, b) if b > 0 else math.nan, t, df)


@F.pandas_udf(T.DoubleType())
def _u_t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _batch(lambda a, b: _t_ppf(a, b) if b > 0 else math.nan, p, df)


@F.pandas_udf(T.DoubleType())
def _u_f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _batch(lambda a, b, c: _f_upper(a, b, c) if b > 0 and c > 0 else math.nan, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def _u_chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _batch(lambda a, b: _gamma_upper(b / 2, a / 2) if b > 0 else math.nan, x, df)


@F.pandas_udf(T.DoubleType())
def _u_ks_p(d: pd.Series, n: pd.Series) -> pd.Series:
    def tail(stat: float, size: float) -> float:
        lam = stat * math.sqrt(size)
        if lam < 0.2:
            return 1.0
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))))
    return _batch(tail, d, n)


def _d(c: Column) -> Column:
    return c.cast("double")


def norm_cdf(x: Column) -> Column:
    return _u_norm_cdf(_d(x))


def norm_two_sided(z: Column) -> Column:
    return F.lit(2.0) * _u_norm_cdf(-F.abs(_d(z)))


def t_two_sided(t: Column, df: Column) -> Column:
    return _u_t_p(_d(t), _d(df))


def t_ppf(p: float, df: Column) -> Column:
    return _u_t_ppf(F.lit(float(p)), _d(df))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    return _u_f_p(_d(f), _d(d1), _d(d2))


def chi2_upper(x: Column, df: Column) -> Column:
    return _u_chi2_p(_d(x), _d(df))


def ks_upper(d: Column, effective_n: Column) -> Column:
    """Asymptotic Kolmogorov tail for the two-sample statistic."""
    return _u_ks_p(_d(d), _d(effective_n))
