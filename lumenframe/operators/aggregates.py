"""Group summaries and the numbers behind charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenframe.functions.columns import col, number, require, safe_div
from lumenframe.operators.ordered import running
from lumenframe.operators.quantiles import column_quantiles, group_quantiles
from lumenframe.operators.ranks import lookup

AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "distinct_count": F.count_distinct, "std": F.stddev_samp, "variance": F.var_samp, "var": F.var_samp,
}


def group_by_aggregate(df: DataFrame, keys: Sequence[str], aggregations: Mapping[str, Sequence[str]],
                       approx: bool = False) -> DataFrame:
    """Columns ``<column>_<fn>`` per group; null keys dropped, unknown functions mean the mean.

    The median is exact unless ``approx``; it is computed aside, because its state is not bounded.
    """
    require(df, [*keys, *aggregations])
    rows = df.dropna(subset=list(keys))
    medians, exprs = [], []
    for column, fns in aggregations.items():
        for fn in [fns] if isinstance(fns, str) else fns:
            label = f"{column}_{fn}"
            if fn == "median" and not approx:
                medians.append((column, label))
            elif fn == "median":
                exprs.append(F.approx_percentile(col(column), 0.5).alias(label))
            elif fn == "distinct_count" and approx:
                exprs.append(F.approx_count_distinct(col(column)).alias(label))
            else:
                exprs.append(AGGREGATES.get(fn, F.avg)(col(column)).alias(label))
    out = rows.groupBy(*[col(k) for k in keys]).agg(*(exprs or [F.count(F.lit(1)).alias("__rows")]))
    for column, label in medians:
        part = group_quantiles(rows, keys, column, [0.5]).select(
            *[col(k).alias(f"__m{i}") for i, k in enumerate(keys)], F.col("q")[0].alias(label))
        same = [col(k) == F.col(f"__m{i}") for i, k in enumerate(keys)]
        out = out.join(part, same, "left").drop(*[f"__m{i}" for i in range(len(keys))])
    ordered = [f"{c}_{fn}" for c, fns in aggregations.items() for fn in ([fns] if isinstance(fns, str) else fns)]
    return out.select(*[col(k) for k in keys], *[col(n) for n in ordered])


def pivot(df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "mean",
          known: Sequence | None = None) -> DataFrame:
    """Wide table; give ``known`` column values to save the pass that finds them."""
    rows = df.dropna(subset=[*index, columns])
    grouped = rows.groupBy(*[col(i) for i in index])
    grouped = grouped.pivot(columns, list(known)) if known is not None else grouped.pivot(columns)
    return grouped.agg(AGGREGATES.get(aggfunc, F.avg)(col(values)))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per pair of values, long form."""
    return df.dropna(subset=[a, b]).groupBy(col(a), col(b)).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values with count and percent of the non-null rows; ties in value order."""
    known = df.where(col(column).isNotNull())
    counts = known.groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))
    total = known.agg(F.count(F.lit(1))).scalar()
    out = counts.withColumn("pct", F.col("n") * 100.0 / total).orderBy(F.desc("n"), col(column))
    return out.limit(top) if top else out


def segment_leaderboard(df: DataFrame, dimension: str, metric: str, top: int | None = None) -> DataFrame:
    """Total, average, count and share of the grand total per segment, largest first."""
    rows = df.dropna(subset=[dimension])
    value = number(df, metric)
    grand = rows.agg(F.sum(value)).scalar()
    out = rows.groupBy(col(dimension).alias("segment")).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.avg(value).alias("average"), F.count(value).alias("n"))
    out = out.withColumn("share_pct", safe_div(F.col("total") * 100, grand)).orderBy(F.desc("total"), "segment")
    return out.limit(top) if top else out


def group_compare(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    value = number(df, metric)
    return (df.dropna(subset=[dimension]).groupBy(col(dimension).alias("segment"))
            .agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count(value).alias("n"))
            .orderBy(F.desc_nulls_last("mean"), "segment"))


def kpi_totals(df: DataFrame, metric: str) -> DataFrame:
    v = number(df, metric)
    return df.agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.count(v).alias("n"),
                  F.min(v).alias("min"), F.max(v).alias("max"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins between min and max; the last bin is closed on both sides."""
    value = number(df, column)
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def box_summary(df: DataFrame, dimension: str, metric: str, factor: float = 1.5) -> DataFrame:
    """Five-number summary per group with the count outside the fences."""
    quartiles = group_quantiles(df, [dimension], metric, [0.0, 0.25, 0.5, 0.75, 1.0])
    fences = quartiles.select(
        col(dimension), F.col("q")[0].alias("min"), F.col("q")[1].alias("q1"), F.col("q")[2].alias("median"),
        F.col("q")[3].alias("q3"), F.col("q")[4].alias("max"))
    reach = (F.col("q3") - F.col("q1")) * factor
    value = F.col("__value")
    # Values are folded to counts before meeting the fences, so a hot group is one row per value.
    folded = (df.dropna(subset=[dimension]).select(col(dimension), number(df, metric).alias("__value"))
              .where(value.isNotNull()).groupBy(col(dimension), "__value").agg(F.count(F.lit(1)).alias("__n")))
    outside = (value < F.col("q1") - reach) | (value > F.col("q3") + reach)
    names = ["min", "q1", "median", "q3", "max"]
    return lookup(folded, fences, [dimension], names).groupBy(col(dimension), *names).agg(
        F.sum("__n").alias("n"), F.coalesce(F.sum(F.when(outside, F.col("__n"))), F.lit(0)).alias("outliers"))


def hierarchy_totals(df: DataFrame, path: Sequence[str], metric: str) -> DataFrame:
    """Sum at every level of the path; ``level`` counts the path columns that are set."""
    rows = df.dropna(subset=list(path))
    level = F.lit(len(path)) - sum((F.grouping(col(p)).cast("int") for p in path), F.lit(0))
    return rows.rollup(*[col(p) for p in path]).agg(F.sum(number(df, metric)).alias("total"), level.alias("level"))


def pareto(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Totals in falling order with running total and running percent."""
    totals = (df.dropna(subset=[dimension]).groupBy(col(dimension).alias("segment"))
              .agg(F.sum(number(df, metric)).alias("total")).where("total is not null"))
    out = running(totals, {"cumulative": ("sum", "total")}, [("total", False), "segment"], row_number="position")
    grand = df.dropna(subset=[dimension]).agg(F.sum(number(df, metric))).scalar()
    return out.withColumn("cumulative_pct", safe_div(F.col("cumulative") * 100, grand))


def concentration(df: DataFrame, dimension: str, metric: str, top_share: float = 0.2) -> DataFrame:
    """Share of the metric held by the first ``top_share`` of the segments (at least one)."""
    ranked = pareto(df, dimension, metric)
    kept = F.greatest(F.lit(1), F.floor(F.lit(float(top_share)) * ranked.agg(F.count(F.lit(1))).scalar()))
    return ranked.where(F.col("position") <= kept).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("total").alias("top_total"), F.max("cumulative_pct").alias("top_pct"))


def funnel(df: DataFrame, user: str, stage: str, stages: Sequence[str]) -> DataFrame:
    """Distinct users per stage, in the order given, with percent of the previous and first stage."""
    rows = df.where(col(stage).isin(list(stages)))
    counts = rows.groupBy(col(stage).alias("stage")).agg(F.count_distinct(col(user)).alias("users"))
    place = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i + 1))])
    w = W.orderBy("position")  # one row per stage
    placed = counts.withColumn("position", place[F.col("stage")])
    before, first = F.lag("users").over(w), F.first("users").over(w)
    return placed.select("position", "stage", "users",
                         safe_div(F.col("users") * 100.0, before).alias("pct_of_previous"),
                         safe_div(F.col("users") * 100.0, first).alias("pct_of_first"))


def waterfall(df: DataFrame, step: str, metric: str) -> DataFrame:
    """Contribution per step and the running level before and after it."""
    totals = (df.dropna(subset=[step]).groupBy(col(step).alias("step"))
              .agg(F.coalesce(F.sum(number(df, metric)), F.lit(0.0)).alias("change")))
    out = running(totals, {"level_after": ("sum", "change")}, "step")
    return out.select("step", "change", (F.col("level_after") - F.col("change")).alias("level_before"), "level_after")


def place_mean(df: DataFrame, place: str, metric: str, top: int = 25) -> DataFrame:
    """Mean and count per place, the highest means first."""
    v = number(df, metric)
    return (df.dropna(subset=[place]).groupBy(col(place).alias("place"))
            .agg(F.avg(v).alias("mean"), F.count(v).alias("n"))
            .orderBy(F.desc_nulls_last("mean"), "place").limit(top))


def best_and_worst(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """The segments with the largest and the smallest total, and the ratio of the two."""
    totals = (df.dropna(subset=[dimension]).groupBy(col(dimension).alias("segment"))
              .agg(F.sum(number(df, metric)).alias("total")).where("total is not null"))
    out = totals.agg(F.min_by("segment", F.struct((-F.col("total")).alias("t"), F.col("segment"))).alias("top"),
                     F.max("total").alias("top_total"),
                     F.min_by("segment", F.struct(F.col("total"), F.col("segment"))).alias("bottom"),
                     F.min("total").alias("bottom_total"))
    return out.withColumn("ratio", safe_div(F.col("top_total"), F.greatest(F.lit(1.0), F.col("bottom_total"))))


def mode_value(df: DataFrame, column: str) -> Column:
    """Most frequent non-null value, the smallest on ties, as a scalar subquery."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v")))).scalar()


def fences(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float] | None]:
    """Quartile fences per column."""
    out: dict[str, tuple[float, float] | None] = {}
    for c, (q1, q3) in column_quantiles(df, columns, [0.25, 0.75]).items():
        out[c] = None if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


