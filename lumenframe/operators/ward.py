"""Agglomerative clustering by Ward's criterion, on clustering features.

A feature is (count, mean, sum of squares about the mean) of some rows; two of them add up to
the feature of both. Every task folds its rows into at most ``leaves`` features in one pass,
without a shuffle of rows; the features of ``fan_in`` tasks at a time are folded again until
one set is left. That set has a fixed size, so the merges are found on the driver. A table
with at most ``leaves`` different points has a leaf for each, and its tree is the exact one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumenframe.functions.columns import col, number, require
from lumenframe.session import ensure_checkpoint_dir

LEAVES, FAN_IN = 1_000, 32
HELD = 64   # times the leaves: different points that a task holds before it halves groups
FEATURES = "part long, n double, mean array<double>, ss double"


class WardTree(NamedTuple):
    """``leaves``: (leaf, n, mean, ss). ``merges``: (step, a, b, cost, height, n), cheapest first.

    a and b name a leaf, or leaves + the step of an earlier merge. The cost is the growth of the sum of
    squares within clusters, the height the square root of twice the cost.
    """
    leaves: DataFrame
    merges: DataFrame
    means: np.ndarray
    pairs: list[tuple[int, int]]


def _equal(n: np.ndarray, mean: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with equal means as one, by their means."""
    order = np.lexsort(mean.T[::-1])
    mean = mean[order]
    first = np.concatenate([[True], (mean[1:] != mean[:-1]).any(axis=1)])
    same = np.cumsum(first) - 1
    return np.bincount(same, n[order]), mean[first], np.bincount(same, ss[order])


def _fold(n: np.ndarray, mean: np.ndarray, ss: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``limit`` features with the same total: equal means are one feature, then the widest group is halved until there are enough."""
    n, mean, ss = _equal(n, mean, ss)
    if len(mean) <= limit:
        return n, mean, ss

    def spread(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = np.average(mean[rows], axis=0, weights=n[rows])
        return centre, (n[rows, None] * (mean[rows] - centre) ** 2).sum(axis=0)

    def entry(rows: np.ndarray, number_: int) -> tuple:
        centre, wide = spread(rows)
        return -wide.sum() if len(rows) > 1 else 0.0, number_, rows, centre, int(wide.argmax())

    heap, made, done = [entry(np.arange(len(mean)), 0)], 1, []
    while heap and len(heap) + len(done) < limit:
        width, _, rows, centre, axis = heapq.heappop(heap)
        if width == 0.0:
            done.append(rows)
            continue
        values = mean[rows, axis]
        low = values <= centre[axis]
        if low.all():
            low = values < values.max()
        for half in (rows[low], rows[~low]):
            heapq.heappush(heap, entry(half, made))
            made += 1
    groups = done + [h[2] for h in heap]
    out = [(n[g].sum(), c, ss[g].sum() + wide.sum()) for g in groups for c, wide in [spread(g)]]
    return np.array([o[0] for o in out]), np.stack([o[1] for o in out]), np.array([o[2] for o in out])


def _frame(part: int, n: np.ndarray, mean: np.ndarray, ss: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": np.full(len(n), part, dtype=np.int64), "n": n, "mean": list(mean), "ss": ss})


def _points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows complete and finite in the columns, with them as one array ``__x``."""
    require(df, columns)
    values = [number(df, c) + F.lit(0.0) for c in columns]
    whole = df.withColumn("__x", F.array(*values))
    return whole.where(F.forall("__x", lambda v: v.isNotNull() & (F.abs(v) < math.inf)))


def features(df: DataFrame, columns: Sequence[str], leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """(n, mean, ss): at most ``leaves`` clustering features whose totals are those of all complete rows."""
    if not columns or leaves < 1 or fan_in < 2:
        raise ValueError("columns, at least one leaf and a fan-in of two are needed")
    ensure_checkpoint_dir(df.sparkSession)

    def absorb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["__x"].to_numpy())
            new = (np.ones(len(x)), x, np.zeros(len(x)))
            # Halving costs a task more than reading, so it waits until many different points are held.
            kept = _equal(*(new if kept is None else [np.concatenate(pair) for pair in zip(kept, _equal(*new))]))
            if len(kept[0]) > HELD * leaves:
                kept = _fold(*kept, leaves)
        if kept is not None:
            yield _frame(TaskContext.get().partitionId(), *_fold(*kept, leaves))

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _frame(key[0], *_fold(group["n"].to_numpy(), np.stack(group["mean"].to_numpy()), group["ss"].to_numpy(), leaves))

    found = _points(df, columns).select("__x").mapInPandas(absorb, FEATURES).checkpoint()
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        found = found.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInPandas(merge, FEATURES).checkpoint()
        parts = -(-parts // fan_in)
    return found.select("n", "mean", "ss")


def _chain(n: np.ndarray, mean: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(a, b, cost, n) of every merge, cheapest first, by nearest-neighbour chains."""
    size, centre = n.astype(float).copy(), mean.astype(float).copy()
    alive, name, least = np.ones(len(n), bool), np.arange(len(n)), np.zeros(len(n))
    raw, chain = [], []
    for made in range(len(n) - 1):
        while True:
            if not chain:
                chain.append(int(alive.argmax()))
            top = chain[-1]
            cost = size[top] * size / (size[top] + size) * ((centre - centre[top]) ** 2).sum(axis=1)
            cost[~alive] = np.inf
            cost[top] = np.inf
            best = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[best]:
                best = chain[-2]
                break
            chain.append(best)
        del chain[-2:]
        a, b = min(top, best), max(top, best)
        # Costs rise along the tree; rounding must not put a merge before its parts.
        price = max(float(cost[best]), least[a], least[b])
        both = size[a] + size[b]
        raw.append((int(name[a]), int(name[b]), price, float(both)))
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / both
        size[a], least[a], name[a], alive[b] = both, price, len(n) + made, False
    order = sorted(range(len(raw)), key=lambda i: (raw[i][2], i))
    place = {len(n) + old: len(n) + new for new, old in enumerate(order)}
    return [tuple(sorted((place.get(raw[i][0], raw[i][0]), place.get(raw[i][1], raw[i][1])))) + raw[i][2:] for i in order]


def ward_tree(df: DataFrame, columns: Sequence[str], leaves: int = LEAVES, fan_in: int = FAN_IN) -> WardTree:
    """The tree of merges. Rows that miss a column or are infinite there take no part; an empty table has no leaves."""
    found = features(df, columns, leaves, fan_in).toPandas()  # at most ``leaves`` rows
    found = found.assign(mean=[tuple(m) for m in found["mean"]]).sort_values("mean", ignore_index=True)
    means = np.array(found["mean"].tolist(), dtype=float).reshape(len(found), len(columns))
    merges = _chain(found["n"].to_numpy(), means)
    spark = df.sparkSession
    leaf_rows = [(i, int(n), [float(v) for v in m], float(s)) for i, (n, m, s) in enumerate(zip(found["n"], means, found["ss"]))]
    merge_rows = [(i, a, b, cost, math.sqrt(2 * cost), int(n)) for i, (a, b, cost, n) in enumerate(merges)]
    return WardTree(spark.createDataFrame(leaf_rows, "leaf int, n long, mean array<double>, ss double"),
                    spark.createDataFrame(merge_rows, "step int, a int, b int, cost double, height double, n long"),
                    means, [(a, b) for a, b, _, _ in merges])


def cut(tree: WardTree, k: int) -> np.ndarray:
    """Cluster of every leaf with all but the k - 1 dearest merges made; numbered by smallest leaf."""
    if k < 1:
        raise ValueError("k must be at least 1")
    count = len(tree.means)
    members = {i: [i] for i in range(count)}
    for step, (a, b) in enumerate(tree.pairs[:max(count - k, 0)]):
        members[count + step] = members.pop(a) + members.pop(b)
    labels = np.zeros(count, dtype=np.int32)
    for number_, group in enumerate(sorted(members.values(), key=min)):
        labels[group] = number_
    return labels


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of every row, the smaller number in ties: products first, differences where products cannot tell."""
    out = np.empty(len(x), dtype=np.int64)
    squares = (centres ** 2).sum(axis=1)
    for start in range(0, len(x), 1_024):
        rows = x[start:start + 1_024]
        own = (rows ** 2).sum(axis=1)
        far = own[:, None] + squares - 2 * rows @ centres.T
        best = far.argmin(axis=1)
        close = far <= (far[np.arange(len(rows)), best] + 1e-12 * len(centres[0]) * (own + squares.max()))[:, None]
        for i in np.flatnonzero(close.sum(axis=1) > 1):
            those = np.flatnonzero(close[i])
            best[i] = those[((centres[those] - rows[i]) ** 2).sum(axis=1).argmin()]
        out[start:start + 1_024] = best
    return out


def ward(df: DataFrame, columns: Sequence[str], k: int, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """Complete rows with ``cluster``: that of the nearest leaf in the tree cut into k clusters.

    With at most ``leaves`` different points the result is exact Ward clustering; beyond, a leaf stands
    for rows close together and its rows stay in one cluster.
    """
    tree = ward_tree(df, columns, leaves, fan_in)
    labels, means = cut(tree, k), tree.means

    @F.pandas_udf("int")
    def assigned(x: pd.Series) -> pd.Series:
        return pd.Series(labels[nearest(np.stack(x.to_numpy()), means)] if len(x) else [], dtype="int32")

    return _points(df, columns).withColumn("cluster", assigned("__x")).select(*[col(c) for c in df.columns], "cluster")
