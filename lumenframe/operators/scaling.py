"""Columns scaled, transformed or binned by statistics of the whole column."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, number, require, safe_div
from lumenframe.operators.ordered import running
from lumenframe.operators.profile import value_facts
from lumenframe.operators.quantiles import column_quantiles


def scale_features(df: DataFrame, columns: Sequence[str], method: str = "standard", replace: bool = False,
                   decimals: int | None = 4) -> DataFrame:
    """standard (population deviation), minmax or robust (median and IQR); gaps take the median first."""
    if method not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown scaling: {method}")
    require(df, columns)
    middle = column_quantiles(df, columns, [0.5])
    filled = {c: F.coalesce(number(df, c), F.lit(middle[c][0])) for c in columns if middle[c][0] is not None}
    names = list(filled)
    if not names:
        return df
    if method == "robust":
        q = column_quantiles(df.select(*[v.alias(c) for c, v in filled.items()]), names, [0.25, 0.5, 0.75])
        stats = {c: (q[c][1], q[c][2] - q[c][0]) for c in names}
    else:
        a, b = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        row = df.agg(*[x for v in filled.values() for x in (a(v), b(v))]).first()
        stats = {c: (row[2 * i], row[2 * i + 1] - (row[2 * i] if method == "minmax" else 0.0))
                 for i, c in enumerate(names)}
    suffix = {"standard": "std", "minmax": "minmax", "robust": "robust"}[method]

    def scaled(c: str) -> Column:
        centre, width = stats[c]
        value = (filled[c] - F.lit(float(centre))) / F.lit(float(width) or 1.0)
        return value if decimals is None else F.bround(value, decimals)

    return df.withColumns({c if replace else f"{c}_{suffix}": scaled(c) for c in names})


def normalize(df: DataFrame, column: str, method: str = "normalize", name: str | None = None,
              decimals: int | None = 4) -> DataFrame:
    """normalize: (x - min) / (max - min + 1e-9); standardize: (x - mean) / (sample deviation + 1e-9)."""
    v = number(df, column)
    if method == "normalize":
        low, high = df.agg(F.min(v)).scalar(), df.agg(F.max(v)).scalar()
        value = safe_div(v - low, high - low + 1e-9)
    elif method == "standardize":
        value = safe_div(v - df.agg(F.avg(v)).scalar(), df.agg(F.stddev_samp(v)).scalar() + 1e-9)
    else:
        raise ValueError(f"unknown method: {method}")
    return df.withColumn(name or f"{column}_{method}", value if decimals is None else F.bround(value, decimals))


def pct_of_total(df: DataFrame, column: str, name: str | None = None, decimals: int | None = 4) -> DataFrame:
    v = number(df, column)
    value = safe_div(v * 100, df.agg(F.sum(v)).scalar())
    return df.withColumn(name or f"{column}_pct_of_total", value if decimals is None else F.bround(value, decimals))


def cumulative_pct(df: DataFrame, column: str, order_by, name: str | None = None,
                   decimals: int | None = 4, **scan) -> DataFrame:
    """Running total as percent of the grand total."""
    out = name or f"{column}_cumulative_pct"
    v = number(df, column)
    done = running(df, {out: ("sum", column)}, order_by, **scan)
    value = F.when(number(df, column).isNotNull(), safe_div(col(out) * 100.0, df.agg(F.sum(v)).scalar()))
    return done.withColumn(out, value if decimals is None else F.bround(value, decimals))


def transform_skewed(df: DataFrame, columns: Sequence[str], method: str = "log1p", replace: bool = False,
                     decimals: int | None = 4) -> DataFrame:
    """log1p after moving a negative minimum to 0, or the square root of the positive part."""
    if method not in ("log1p", "sqrt"):
        raise ValueError(f"unknown method: {method}")
    lows = df.agg(*[F.min(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for c, low in zip(columns, lows):
        v = number(df, c)
        if method == "log1p":
            moved = v + abs(low) if low is not None and low < 0 else v
            value = F.when(v.isNotNull(), F.log1p(F.greatest(moved, F.lit(0.0))))
        else:
            value = F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))
        out[c if replace else f"{c}_{method}"] = value if decimals is None else F.bround(value, decimals)
    return df.withColumns(out)


def _place(v: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval; the first one holds its lower edge."""
    out = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        out = F.when(v <= edges[i + 1], F.lit(labels[i])).otherwise(out)
    return F.when((v >= edges[0]) & (v <= edges[-1]), out)


def bin_feature(df: DataFrame, column: str, bins: int = 5, strategy: str = "quantile", name: str | None = None) -> DataFrame:
    """Labels Bin_1..Bin_n. Quantile edges that coincide leave the table as it is."""
    unique = value_facts(df, [column])[column]["unique"]
    wanted = max(2, min(bins, unique))
    edges = _edges(df, column, wanted, strategy)
    if len(edges) != wanted + 1:
        return df
    labels = [f"Bin_{i + 1}" for i in range(wanted)]
    return df.withColumn(name or f"{column}_binned", _place(number(df, column), edges, labels))


def _edges(df: DataFrame, column: str, bins: int, strategy: str) -> list[float]:
    if strategy == "quantile":
        q = column_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
        return sorted(set(q)) if q[0] is not None else []
    v = number(df, column)
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return []
    if low == high:
        reach = 0.001 * abs(low) if low else 0.001
        return [float(e) for e in np.linspace(low - reach, high + reach, bins + 1)]
    edges = [float(e) for e in np.linspace(low, high, bins + 1)]
    return [edges[0] - (high - low) * 0.001, *edges[1:]]


def _show(x: float, precision: int = 3) -> float:
    if x == 0 or not math.isfinite(x):
        return x
    whole = math.trunc(x)
    digits = precision if whole else precision - 1 - math.floor(math.log10(abs(x)))
    return round(x, digits)


def bin_column(df: DataFrame, column: str, method: str = "equal_width", bins: int = 5,
               labels: Sequence[str] | None = None, custom_edges: Sequence[float] | None = None,
               name: str | None = None) -> DataFrame:
    """Interval labels such as "(1.5, 3.0]"; values outside custom edges become null."""
    if method == "custom":
        if not custom_edges:
            raise ValueError("custom bins need edges")
        edges = [float(e) for e in custom_edges]
    elif method in ("equal_width", "quantile"):
        edges = _edges(df, column, bins, "quantile" if method == "quantile" else "uniform")
    else:
        raise ValueError(f"unknown method: {method}")
    if len(edges) < 2:
        raise ValueError("the column has no values to bin")
    if labels is None:
        shown = [_show(e) for e in edges]
        if method != "equal_width":
            shown[0] = round(shown[0] - 0.001, 3)
        labels = [f"({float(a)}, {float(b)}]" for a, b in zip(shown, shown[1:])]
    elif len(labels) != len(edges) - 1:
        raise ValueError("one label per interval")
    return df.withColumn(name or f"{column}_bin", _place(number(df, column), edges, labels))
