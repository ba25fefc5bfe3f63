"""Exact quantiles (linear interpolation) whose memory does not grow with the data.

``percentile`` keeps every distinct value of a group in one task. It is used only where a
count has shown the group to be small. Beyond that the answer is bracketed with a sketch,
and only the values inside the bracket are looked at; if they are still too many, they go
through the range-cut cumulative count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenframe.functions.columns import col, number
from lumenframe.operators.ordered import running
from lumenframe.session import ensure_checkpoint_dir

SMALL_GROUP = 1_000_000
SMALL_COLUMN = 100_000
ACCURACY = 10_000


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     small: int = SMALL_COLUMN, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as driver numbers: one list per column.

    Scan 1 counts and sketches every column. Small columns take ``percentile`` in scan 2. For
    the others scan 2 counts the values below and inside each bracket, scan 3 reads the inside.
    """
    if not columns:
        return {}
    values = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    slack = 2.0 / accuracy
    ends = [x for p in probs for x in (max(0.0, p - slack), min(1.0, p + slack))]
    first = values.agg(*[x for i in range(len(columns)) for x in (
        F.count(f"c{i}").alias(f"n{i}"), F.approx_percentile(f"c{i}", ends, accuracy).alias(f"q{i}"))]).first()
    result: dict[str, list[float | None]] = {}
    narrow = [i for i in range(len(columns)) if first[f"n{i}"] <= small]
    wide = [i for i in range(len(columns)) if first[f"n{i}"] > small]
    if narrow:
        row = values.agg(*[F.percentile(f"c{i}", F.array(*[F.lit(float(p)) for p in probs])).alias(f"c{i}")
                           for i in narrow]).first()
        for i in narrow:
            result[columns[i]] = list(row[f"c{i}"]) if row[f"c{i}"] is not None else [None] * len(probs)
    if wide:
        found = _bracketed(values, [(i, p, first[f"n{i}"], first[f"q{i}"][2 * j], first[f"q{i}"][2 * j + 1])
                                    for i in wide for j, p in enumerate(probs)], slack, small)
        for k, i in enumerate(wide):
            result[columns[i]] = found[k * len(probs):(k + 1) * len(probs)]
    return result


def _bracketed(values: DataFrame, asked: Sequence[tuple[int, float, int, float, float]], slack: float,
               small: int) -> list[float]:
    """Quantile per (column number, probability, rows, lower sketch value, upper sketch value)."""
    low = [a if p - slack > 0 else -math.inf for _, p, _, a, _ in asked]
    high = [b if p + slack < 1 else math.inf for _, p, _, _, b in asked]
    counts = values.agg(*[x for j, (i, *_) in enumerate(asked) for x in (
        F.count_if(F.col(f"c{i}") < low[j]).alias(f"b{j}"),
        F.count_if(F.col(f"c{i}").between(low[j], high[j])).alias(f"i{j}"))]).first()
    place = [(n - 1) * p for _, p, n, _, _ in asked]
    below, answer, inside_rows = [], {}, 0
    for j, (_, _, n, _, _) in enumerate(asked):
        before, within = counts[f"b{j}"], counts[f"i{j}"]
        # A bracket that misses its order statistics is opened fully: the sketch is never trusted blindly.
        if not (before <= math.floor(place[j]) and math.ceil(place[j]) < before + within):
            low[j], high[j], before, within = -math.inf, math.inf, 0, n
        below.append(before)
        if low[j] == high[j]:
            answer[j] = low[j]
        else:
            inside_rows += within
    todo = [j for j in range(len(asked)) if j not in answer]
    if not todo:
        return [answer[j] for j in range(len(asked))]

    def within_bracket(j: int) -> Column:
        return F.col(f"c{asked[j][0]}").between(low[j], high[j])

    kept = values.where(reduce(lambda a, b: a | b, [within_bracket(j) for j in todo]))
    inside = kept.select(F.explode(F.array(*[
        F.when(within_bracket(j), F.struct(F.lit(j).alias("j"), F.col(f"c{asked[j][0]}").alias("v"))) for j in todo
    ])).alias("x")).where("x is not null").select("x.j", "x.v")
    folded = inside.groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
    if inside_rows <= small:
        cumulated = folded.withColumn("upto", F.sum("n").over(W.partitionBy("j").orderBy("v")))
    else:
        cumulated = running(folded, {"upto": ("sum", "n")}, ["v"], ["j"])
    first = F.array(*[F.lit(math.floor(p) - b) for p, b in zip(place, below)])
    last = F.array(*[F.lit(math.ceil(p) - b) for p, b in zip(place, below)])
    at = F.col("j") + 1
    found = {r["j"]: r for r in cumulated.groupBy("j").agg(
        F.min(F.when(F.col("upto") > F.element_at(first, at), F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > F.element_at(last, at), F.col("v"))).alias("b")).collect()}
    for j in todo:
        answer[j] = found[j]["a"] + (found[j]["b"] - found[j]["a"]) * (place[j] - math.floor(place[j]))
    return [answer[j] for j in range(len(asked))]


def group_quantiles(df: DataFrame, by: Sequence[str], column: str, probs: Sequence[float],
                    small: int = SMALL_GROUP) -> DataFrame:
    """Quantiles per group as an array column ``q``; null keys dropped.

    Groups of at most ``small`` rows use ``percentile``; larger ones the cumulative count.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    rows = df.dropna(subset=list(by)).select(
        *[col(b).alias(k) for b, k in zip(by, keys)], number(df, column).alias("__v")).where("__v is not null")
    # At most rows / small groups are this large. They are written once: each use of them would count the rows again.
    ensure_checkpoint_dir(df.sparkSession)
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > small).checkpoint()
    array = F.array(*[F.lit(float(p)) for p in probs])
    has_large = bool(large.take(1))
    little = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti") if has_large else rows
    out = little.groupBy(*keys).agg(F.percentile("__v", array).alias("q"))
    if has_large:
        out = out.unionByName(_large_groups(rows.join(F.broadcast(large), keys), keys, probs))
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], "q")


def _large_groups(rows: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    # Written once, as its order is cut into ranges before it is added up.
    folded = rows.groupBy(*keys, "__size", "__v").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    cumulated = running(folded, {"upto": ("sum", "n")}, ["__v"], keys)
    picks = []
    for i, p in enumerate(probs):
        place = (F.col("__size") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("upto") > F.floor(place), F.col("__v"))).alias(f"a{i}"))
        picks.append(F.min(F.when(F.col("upto") > F.ceil(place), F.col("__v"))).alias(f"b{i}"))
    found = cumulated.groupBy(*keys, "__size").agg(*picks)
    parts = []
    for i, p in enumerate(probs):
        place = (F.col("__size") - 1) * F.lit(float(p))
        parts.append(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (place - F.floor(place)))
    return found.select(*keys, F.array(*parts).alias("q"))
