"""Isolation forest: small trees grown from hash samples, scores in parallel."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.functions.columns import col, number
from lumenframe.operators.cleaning import apply_bounds
from lumenframe.operators.neighbours import flag_highest, local_outlier_factor
from lumenframe.operators.quantiles import column_quantiles
from lumenframe.session import ensure_checkpoint_dir

SCORED_ROWS = 50_000    # rows that a task scores, about


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> list:
    """Nested [column, cut, left, right], or [size] at a leaf."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth == 0 or not len(spread):
        return [len(x)]
    j = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
    left = x[:, j] < cut
    return [j, cut, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng)]


class Forest(NamedTuple):
    """All trees as arrays of nodes; a leaf is its own child, ``path`` its depth and the average path of its size."""
    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: list[int]
    depth: int


def _flat(trees: Sequence[list]) -> Forest:
    nodes: list[tuple] = []

    def add(tree: list, depth: int) -> int:
        at = len(nodes)
        if len(tree) == 1:
            nodes.append((0, 0.0, at, at, depth + float(_average_path(tree[0])), depth))
        else:
            nodes.append(())
            nodes[at] = (tree[0], tree[1], add(tree[2], depth + 1), add(tree[3], depth + 1), 0.0, depth)
        return at

    roots = [add(t, 0) for t in trees]
    column, cut, left, right, path, depth = (np.array(c) for c in zip(*nodes))
    return Forest(column, cut, left, right, path, roots, int(depth.max()))


def _mean_path(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Mean path of every row: all rows go down a tree level by level, trees are added in their order."""
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for root in forest.roots:
        at = np.full(len(x), root)
        for _ in range(forest.depth):
            at = np.where(x[rows, forest.column[at]] < forest.cut[at], forest.left[at], forest.right[at])
        out += forest.path[at]
    return out / len(forest.roots)


def isolation_scores(df: DataFrame, key: str, columns: Sequence[str], trees: int = 100, sample: int = 256,
                     seed: int = 42) -> DataFrame:
    """(key, score): 2 ^ -(mean path / average path); close to 1 is easy to isolate.

    A row belongs to the sample of tree t by a hash of its key and t. Trees grow in tasks, one
    group of about ``sample`` rows per tree, and come back as 100 small lists.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.dropna(subset=list(columns)).select(col(key).alias("id"), F.array(*[number(df, c) for c in columns]).alias("x"))
    total = rows.count()
    if total <= 10:
        raise ValueError("more than ten complete rows are needed")
    size = min(sample, total)
    # About 1.5 times the sample is sent to each tree, which keeps the smallest hashes.
    share = min(1.0, 1.5 * size / total)
    tree = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(
        F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))))
    drawn = rows.select("x", "id", tree.alias("tree")).withColumn("h", F.xxhash64("id", "tree", F.lit(seed)))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        kept = part.sort_values("h").head(size)
        number_of = int(part["tree"].iloc[0])
        x = np.array(kept["x"].tolist(), dtype=float)
        tree = _grow(x, math.ceil(math.log2(max(len(x), 2))), np.random.default_rng([seed, number_of]))
        return pd.DataFrame({"tree": [number_of], "body": [repr(tree)]})

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, body string").orderBy("tree").collect()
    forest = _flat([ast.literal_eval(r["body"]) for r in grown])
    scale = float(_average_path(size)) or 1.0

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch["x"].tolist(), dtype=float)
                yield pd.DataFrame({key: batch["id"], "score": 2.0 ** (-_mean_path(forest, x) / scale)})

    kind = df.schema[key].dataType.simpleString()
    # Dealt by key: a table in one row group would be scored by one task. Written once, as quantiles read scores again.
    dealt = rows.repartition(max(1, math.ceil(total / SCORED_ROWS)), "id")
    return dealt.mapInPandas(rate, f"`{key}` {kind}, score double").checkpoint()


def model_outliers(df: DataFrame, key: str, columns: Sequence[str], method: str = "isolation_forest", action: str = "cap",
                   contamination: float = 0.05, **settings) -> DataFrame:
    """Rows an isolation forest or the local outlier factor finds unusual.

    remove drops them, set_nan empties their columns, keep leaves all rows; cap clips whole
    columns to their 1st and 99th percentile. Rows with gaps are never outliers.
    """
    if action == "cap":
        limits = {c: tuple(q) for c, q in column_quantiles(df, columns, [0.01, 0.99]).items() if q[0] is not None}
        return apply_bounds(df, limits, "cap")
    if action == "keep":
        return df
    if method == "isolation_forest":
        scores = flag_highest(isolation_scores(df, key, columns, **settings), "score", contamination)
    elif method == "lof":
        scores = flag_highest(local_outlier_factor(df, key, columns, **settings), "lof", contamination)
    else:
        raise ValueError(f"unknown method: {method}")
    found = scores.where("outlier").select(col(key).alias("__key"))
    if action == "remove":
        return df.join(found, col(key) == F.col("__key"), "left_anti")
    marked = df.join(found, col(key) == F.col("__key"), "left")
    return marked.select(*[F.when(F.col("__key").isNull(), col(c)).alias(c) if c in columns else col(c) for c in df.columns])
