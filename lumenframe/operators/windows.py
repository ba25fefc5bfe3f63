"""Window columns over an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from lumenframe.functions.columns import col, safe_div
from lumenframe.operators.ordered import fill, layout, over_rows, running
from lumenframe.operators.ranks import lookup

_ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}


def rolling(df: DataFrame, column: str, fn: str, window: int, order_by, partition_by: Sequence[str] = (),
            name: str | None = None, centred: bool = False, **scan) -> DataFrame:
    """Aggregate of the last ``window`` rows (or centred on the row), nulls skipped."""
    if fn not in _ROLLING:
        raise ValueError(f"unknown rolling function: {fn}")
    before, after = (window // 2, (window - 1) // 2) if centred else (window - 1, 0)
    value = _ROLLING[fn](col(column))
    out = name or f"{column}_rolling_{fn}"
    return over_rows(df, {out: value}, before, after, order_by, partition_by, **scan)


def cumulative(df: DataFrame, column: str, fn: str, order_by, partition_by: Sequence[str] = (),
               name: str | None = None, **scan) -> DataFrame:
    """cumsum | cumprod | expanding_mean; sums and products stay null on null rows."""
    kinds = {"cumsum": "sum", "cumprod": "prod", "expanding_mean": "mean"}
    if fn not in kinds:
        raise ValueError(f"unknown cumulative function: {fn}")
    out = name or f"{column}_{fn}"
    done = running(df, {out: (kinds[fn], column)}, order_by, partition_by, **scan)
    return done if fn == "expanding_mean" else done.withColumn(out, F.when(col(column).isNotNull(), col(out)))


def shift(df: DataFrame, column: str, periods: int, order_by, partition_by: Sequence[str] = (),
          name: str | None = None, **scan) -> DataFrame:
    """Value ``periods`` rows back (lag), or ahead for negative periods (lead)."""
    out = name or f"{column}_{'lag' if periods >= 0 else 'lead'}_{abs(periods)}"
    return over_rows(df, {}, 0, 0, order_by, partition_by, shifts={out: (column, periods)}, **scan)


def pct_change(df: DataFrame, column: str, periods: int, order_by, partition_by: Sequence[str] = (),
               name: str | None = None, **scan) -> DataFrame:
    """Relative change to ``periods`` rows back, after filling gaps forward."""
    out = name or f"{column}_pct_change"
    scan.setdefault("shared", layout(df, order_by, partition_by, scan.get("ranges")))
    filled = fill(df, {"__filled": (column, "forward")}, order_by, partition_by, **scan)
    shifted = over_rows(filled, {}, 0, 0, order_by, partition_by, shifts={"__back": ("__filled", periods)}, **scan)
    change = safe_div((F.col("__filled") - F.col("__back")).cast("double"), F.col("__back"))
    return shifted.withColumn(out, change).drop("__filled", "__back")


def top_k_per_group(df: DataFrame, by: Sequence[str], metric: str, k: int, name: str = "rank") -> DataFrame:
    """Rows whose dense rank by falling metric is at most k, ties included.

    The k largest distinct values per group are found first; rows then only have to be looked up.
    """
    known = df.where(col(metric).isNotNull())
    w = W.partitionBy(*[col(b) for b in by]).orderBy(col(metric).desc())
    distinct = known.groupBy(*[col(b) for b in by], col(metric)).agg(F.count(F.lit(1)).alias("__n"))
    # A filtered row_number also runs before the shuffle, so a hot group sends k rows per task.
    best = distinct.withColumn(name, F.row_number().over(w)).where(col(name) <= k)
    return lookup(known, best, [*by, metric], [name], "__n").where(col(name).isNotNull())

