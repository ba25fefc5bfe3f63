"""Pearson, Spearman and Kendall correlation, covariance and target association."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenframe.functions import dist
from lumenframe.functions.columns import col, is_numeric, number, numeric_columns, safe_div
from lumenframe.operators.ordered import RANGE, cut
from lumenframe.operators.profile import value_facts
from lumenframe.operators.ranks import average_rank, lookup, value_ranks

PAIR_SCHEMA = "var1 string, var2 string, n long, coefficient double"


def _strength(c: Column, strong: float, moderate: float) -> Column:
    return (F.when(F.abs(c) >= strong, "Strong").when(F.abs(c) >= moderate, "Moderate").otherwise("Weak"))


def _pairs(df: DataFrame, columns: Sequence[str] | None) -> tuple[list[str], list[tuple[str, str]]]:
    names = [c for c in (columns or df.columns) if c in numeric_columns(df)]
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    return names, list(combinations(names, 2))


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All pairs over the rows where both values are known, from one aggregate."""
    _, pairs = _pairs(df, columns)
    exprs = []
    for i, (a, b) in enumerate(pairs):
        x, y = number(df, a), number(df, b)
        exprs += [F.corr(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
    row = df.agg(*exprs).first()
    out = df.sparkSession.createDataFrame([(a, b, row[f"n{i}"], row[f"r{i}"]) for i, (a, b) in enumerate(pairs)],
                                          PAIR_SCHEMA)
    c = F.col("coefficient")
    return out.where(c.isNotNull()).withColumns({
        "strength": _strength(c, 0.7, 0.4), "direction": F.when(c >= 0, "Positive").otherwise("Negative"),
        "collinear": F.abs(c) >= 0.8})


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson",
                       top: int | None = None) -> DataFrame:
    """Pairs over the rows complete in all columns, strongest first."""
    names, pairs = _pairs(df, columns)
    rows = df.select(*[number(df, c).alias(c) for c in names]).dropna()
    if method == "pearson":
        out = pearson_pairs(rows, names).select("var1", "var2", "n", "coefficient")
    elif method in ("spearman", "kendall"):
        fn = spearman if method == "spearman" else kendall
        out = None
        for a, b in pairs:
            one = fn(rows, a, b)
            out = one if out is None else out.unionByName(one)
    else:
        raise ValueError(f"unknown method: {method}")
    c = F.col("coefficient")
    out = out.where(c.isNotNull()).withColumns({
        "strength": _strength(c, 0.7, 0.35), "direction": F.when(c >= 0, "Positive").otherwise("Negative")})
    out = out.orderBy(F.abs(c).desc(), "var1", "var2")
    return out.limit(top) if top else out


def covariance_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sample covariance of every pair (and each column with itself) over complete rows, long form."""
    names, pairs = _pairs(df, columns)
    rows = df.select(*[number(df, c).alias(c) for c in names]).dropna()
    asked = [(c, c) for c in names] + pairs
    row = rows.agg(*[F.covar_samp(col(a), col(b)) for a, b in asked]).first()
    return df.sparkSession.createDataFrame([(a, b, v) for (a, b), v in zip(asked, row)],
                                           "var1 string, var2 string, covariance double")


def _folded(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = df.select(number(df, x).alias("x"), number(df, y).alias("y")).dropna()
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks on ties; works on the folded (x, y) pairs."""
    rows = df.select(number(df, x).alias("x"), number(df, y).alias("y")).dropna()
    ranks = {n: value_ranks(rows, n).withColumn(f"r{n}", average_rank()) for n in ("x", "y")}
    out = lookup(_folded(df, x, y), ranks["x"], ["x"], ["rx"], "__n")
    out = lookup(out, ranks["y"], ["y"], ["ry"], "__n")
    middle = (rows.agg(F.count(F.lit(1))).scalar() + 1) / 2
    a, b, w = F.col("rx") - middle, F.col("ry") - middle, F.col("w")
    return out.select(a.alias("a"), b.alias("b"), w).agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("a") * F.col("b")).alias("ab"),
        F.sum(F.col("w") * F.col("a") * F.col("a")).alias("aa"),
        F.sum(F.col("w") * F.col("b") * F.col("b")).alias("bb")).select(
        F.lit(x).alias("var1"), F.lit(y).alias("var2"), "n",
        safe_div(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")).alias("coefficient"))


def _ordered_pairs(first: np.ndarray, second: np.ndarray, weight: np.ndarray,
                   apart: np.ndarray | None = None) -> float:
    """Weighted number of pairs i, j with first[i] < first[j] and second[i] < second[j].

    Both orders are free of ties. With ``apart``, pairs that share its value do not count;
    it must not fall along ``first``. Merge by doubling block length, vectorised.
    """
    order = np.argsort(first, kind="stable")
    second, weight = second[order], weight[order].astype(float)
    n, total, size = len(order), 0.0, 1
    if apart is not None:
        group = apart[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        inside = sum(_ordered_pairs(np.arange(e - s), second[s:e], weight[s:e])
                     for s, e in zip(starts, np.r_[starts[1:], n]) if e - s > 1)
        return _ordered_pairs(np.arange(n), second, weight) - inside
    place = np.arange(n)
    while size < n:
        block = place // (2 * size)
        left = (place // size) % 2 == 0
        by_value = np.lexsort((second, block))
        in_left = np.where(left[by_value], weight[by_value], 0.0)
        run = np.cumsum(in_left)
        starts = np.searchsorted(block[by_value], block[by_value], side="left")
        run = run - np.where(starts > 0, run[starts - 1], 0.0)
        total += float((np.where(left[by_value], 0.0, weight[by_value]) * run).sum())
        size *= 2
    return total


def _across(cells: DataFrame, ranges: int) -> DataFrame:
    """Weighted pairs of cells (bx, by, w) that rise on both axes, as a merge sort counts them.

    Two ranges of x part at one bit: above it they are alike, there the lower has 0 and the higher 1.
    So each level is a merge of halves: along y, the weight of lower halves before meets that of the
    higher ones. A cell has one row per bit, added up before the shuffle; a window has a row per range of y.
    """
    bits = cells.select("bx", "by", "w", F.explode(F.sequence(F.lit(0), F.lit(max(ranges - 1, 1).bit_length() - 1))).alias("level"))
    high = F.expr("shiftright(bx, level) & 1") == 1
    halves = bits.groupBy("level", F.expr("shiftright(bx, level + 1)").alias("prefix"), "by").agg(
        F.sum(F.when(~high, F.col("w"))).alias("lower"), F.sum(F.when(high, F.col("w"))).alias("higher"))
    before = F.sum("lower").over(W.partitionBy("level", "prefix").orderBy("by").rowsBetween(W.unboundedPreceding, -1))
    return halves.withColumn("before", before).agg(F.sum(F.col("higher") * F.col("before")))


def kendall(df: DataFrame, x: str, y: str, rows_per_range: int = 200_000) -> DataFrame:
    """Kendall tau-b without forming pairs of rows.

    Distinct (x, y) pairs, with their counts, are placed in ranges of both sort orders
    (x, y) and (y, x). Pairs of points in different ranges on both axes are counted from the
    weights of occupied cells; the rest meet in one range of either axis and are counted there.
    """
    pairs = _folded(df, x, y)
    ranges = max(2, -(-pairs.count() // rows_per_range))
    by_x = cut(pairs, ["x", "y"], ranges=ranges).df.withColumnRenamed(RANGE, "bx")
    placed = cut(by_x, ["y", "x"], ranges=ranges).df.withColumnRenamed(RANGE, "by")

    def in_range(other: str | None):
        def count(part: pd.DataFrame) -> pd.DataFrame:
            xs, ys = part["x"].to_numpy(), part["y"].to_numpy()
            first, second = np.empty(len(part)), np.empty(len(part))
            first[np.lexsort((ys, xs))] = np.arange(len(part))
            second[np.lexsort((xs, ys))] = np.arange(len(part))
            apart = part[other].to_numpy() if other else None
            return pd.DataFrame({"q": [_ordered_pairs(first, second, part["w"].to_numpy(), apart)]})
        return count

    same_x = placed.groupBy("bx").applyInPandas(in_range(None), "q double")
    same_y = placed.groupBy("by").applyInPandas(in_range("bx"), "q double")
    across = _across(placed.groupBy("bx", "by").agg(F.sum("w").cast("double").alias("w")), ranges).scalar()
    q = same_x.agg(F.coalesce(F.sum("q"), F.lit(0.0))).scalar() + same_y.agg(
        F.coalesce(F.sum("q"), F.lit(0.0))).scalar() + F.coalesce(across, F.lit(0.0))

    def tied(*keys: str) -> Column:
        t = pairs.groupBy(*keys).agg(F.sum("w").cast("double").alias("t"))
        return t.agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).scalar()

    facts = pairs.agg(F.sum("w").alias("n")).select(
        "n", q.alias("q"), tied("x").alias("tx"), tied("y").alias("ty"), tied("x", "y").alias("txy"))
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    # Pairs tied in one variable are ordered alike in both sort orders and are taken off again.
    concordant = F.col("q") - (F.col("tx") - F.col("txy")) - (F.col("ty") - F.col("txy"))
    discordant = n0 - F.col("tx") - F.col("ty") + F.col("txy") - concordant
    tau = safe_div(concordant - discordant, F.sqrt(n0 - F.col("tx")) * F.sqrt(n0 - F.col("ty")))
    return facts.select(F.lit(x).alias("var1"), F.lit(y).alias("var2"), "n", tau.alias("coefficient"))


def target_association(df: DataFrame, target: str) -> DataFrame:
    """Numeric columns against the target, strongest first.

    A numeric target with over ten values is correlated (Pearson r, p); otherwise the
    columns are compared between its values (one-way F, p).
    """
    numbers = [c for c in numeric_columns(df) if c != target]
    continuous = is_numeric(df, target) and value_facts(df, [target])[target]["unique"] > 10
    spark = df.sparkSession
    if continuous:
        y, exprs = number(df, target), []
        for i, c in enumerate(numbers):
            x = number(df, c)
            exprs += [F.corr(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
        row = df.agg(*exprs).first()
        found = spark.createDataFrame([(c, row[f"n{i}"], row[f"r{i}"]) for i, c in enumerate(numbers)],
                                      "feature string, n long, score double").where("n > 5 and score is not null")
        t = safe_div(F.col("score") * F.sqrt(F.col("n").cast("double") - 2), F.sqrt(1 - F.col("score") * F.col("score")))
        return found.select("feature", F.lit("Pearson r").alias("metric"), "score",
                            dist.t_two_sided(t, F.col("n") - 2).alias("p_value")).orderBy(F.abs("score").desc(), "feature")
    rows = df.dropna(subset=[target]).select(col(target).alias("g"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), number(df, c).alias("v")) for c in numbers])).alias("s"))
    groups = rows.select("g", "s.feature", "s.v").where("v is not null").groupBy("feature", "g").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("ss"))
    w = W.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    sums = groups.withColumn("grand", grand).groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("within"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between")).where("k > 1")
    f = safe_div(F.col("between") / (F.col("k") - 1), safe_div(F.col("within"), F.col("n") - F.col("k")))
    return sums.select("feature", F.lit("ANOVA F").alias("metric"), f.alias("score"),
                       dist.f_upper(f, F.col("k") - 1, F.col("n") - F.col("k")).alias("p_value")
                       ).where("score is not null").orderBy(F.desc("score"), "feature")
