"""Density clustering on a grid, without forming all pairs of close points.

Tables with more columns than a grid can serve go to ``balls``.

Cells have the side eps / sqrt(d), so two points of a cell are always neighbours: a cell
with ``min_samples`` points needs no distance at all. Points of thinner cells (fewer than
``min_samples``) are sent to the cells around them, where distances are counted in chunks of
bounded size. Which cells touch is settled by comparing boxes that are split until a pair
of points is close enough or no pair can be; only undecided boxes go on.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, number
from lumenframe.operators.balls import ball_labels
from lumenframe.operators.components import connected_components
from lumenframe.operators.neighbours import CHUNK_ROWS, _distances, _matrix
from lumenframe.operators.ordered import with_row_number
from lumenframe.operators.ranks import lookup
from lumenframe.session import ensure_checkpoint_dir

# With more columns a cell has too many cells around it; balls take over.
GRID_COLUMNS = 4


def _cell(x: Column, side: float, d: int) -> Column:
    return F.array(*[F.floor(x[i] / F.lit(side)).cast("long") for i in range(d)])


def _around(side: float, eps: float, d: int) -> list[tuple[int, ...]]:
    """Offsets of cells that can hold a point within eps."""
    reach = math.ceil(math.sqrt(d))
    return [o for o in itertools.product(range(-reach, reach + 1), repeat=d)
            if math.sqrt(sum((max(abs(v) - 1, 0) * side) ** 2 for v in o)) <= eps]


def dbscan(df: DataFrame, key: str, columns: Sequence[str], eps: float, min_samples: int = 5,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, cluster): clusters numbered from 0 by their smallest core key, -1 for noise.

    Core points have ``min_samples`` points within eps, themselves included. A border point
    takes the cluster of its core neighbour with the smallest key. Up to four columns use a
    grid, more use balls. Rows with gaps are left out.
    """
    if not columns:
        raise ValueError("at least one column is needed")
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.dropna(subset=list(columns)).select(
        col(key).alias("id"), F.array(*[number(df, c) + F.lit(0.0) for c in columns]).alias("x"))
    # Copies of a point share its label: one row per place, with its weight and smallest key.
    places = rows.groupBy("x").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("id")).checkpoint()
    if len(columns) <= GRID_COLUMNS:
        labels = _grid_labels(places, len(columns), eps, min_samples, chunk_rows)
    else:
        labels = ball_labels(places, eps, min_samples, chunk_rows)
    labels = labels.checkpoint()    # read three times
    # Clusters are few compared with points, but still numbered without one task: rank over the distinct labels.
    numbers = with_row_number(labels.select("label").distinct(), "label", name="__n").select(
        F.col("label").alias("__l"), (F.col("__n") - 1).cast("int").alias("cluster"))
    numbered = labels.join(numbers, F.col("label") == F.col("__l")).select("id", "cluster")
    by_place = places.select("id", "x", F.col("w").alias("__n")).join(numbered, "id", "left")
    return lookup(rows, by_place.select("x", "cluster", "__n"), ["x"], ["cluster"], "__n").select(
        F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def _grid_labels(places: DataFrame, d: int, eps: float, min_samples: int, chunk_rows: int) -> DataFrame:
    """(id, label): the smallest core id of a point's cluster; noise has no row."""
    side = eps / math.sqrt(d) * (1 - 1e-12)
    places = places.withColumn("cell", _cell(F.col("x"), side, d))
    cells = places.groupBy("cell").agg(F.sum("w").alias("cw"), F.count(F.lit(1)).alias("cn"))
    sized = places.join(cells, "cell")
    dense = F.col("cw") >= min_samples
    thin = sized.where(~dense).select("id", "x", "w", "cell")
    counted = _meet(thin, sized, side, eps, d, chunk_rows, "count")
    totals = counted.groupBy("id").agg(F.sum("value").alias("near"))
    core = sized.where(dense).select("id", "x", "w", "cell").union(
        thin.join(totals.where(F.col("near") >= min_samples).select("id"), "id").select("id", "x", "w", "cell")).checkpoint()
    groups = core.groupBy("cell").agg(F.min("id").alias("node"))
    edges = _touching(core, side, eps, d)
    named = edges.join(groups.select(F.col("cell").alias("ca"), F.col("node").alias("a")), "ca").join(
        groups.select(F.col("cell").alias("cb"), F.col("node").alias("b")), "cb").select("a", "b")
    parts = connected_components(groups.select("node"), named)
    cell_label = groups.join(parts, "node").select("cell", "component")
    core_label = core.join(cell_label, "cell").select("id", F.col("component").alias("label"))
    border = thin.join(core.select("id"), "id", "left_anti")
    held = core.join(core.groupBy("cell").agg(F.count(F.lit(1)).alias("cn")), "cell")
    near_core = _meet(border, held, side, eps, d, chunk_rows, "first").groupBy("id").agg(F.min("value").alias("core"))
    border_label = near_core.join(core_label.withColumnRenamed("id", "core"), "core").select("id", "label")
    return core_label.union(border_label)


def _fresh(*names: str) -> list[Column]:
    """Columns under the same names but new identities, as cogrouping tables of one origin needs."""
    return [F.col(n).alias(n) for n in names]


def _meet(few: DataFrame, many: DataFrame, side: float, eps: float, d: int, chunk_rows: int, what: str) -> DataFrame:
    """For every point of ``few`` and chunk of ``many`` around it: weight within eps, or smallest id there.

    A cell sends fewer than ``min_samples`` points, so a chunk meets a bounded number of them.
    """
    around = F.array(*[F.array(*[F.lit(v) for v in o]) for o in _around(side, eps, d)])
    sent = few.select("id", "x", F.explode(F.transform(around, lambda o: F.zip_with(F.col("cell"), o, lambda a, b: a + b))).alias("cell"))
    chunks = many.groupBy("cell").agg((F.ceil(F.max("cn") / chunk_rows)).cast("int").alias("chunks"))
    left = sent.join(chunks, "cell").select(*_fresh("id", "x", "cell"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = many.select(*_fresh("id", "x", "w", "cell"), F.pmod(F.xxhash64("x"), F.ceil(F.col("cn") / chunk_rows)).cast("int").alias("chunk"))
    kind = few.schema["id"].dataType.simpleString()

    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            qs, ps = _matrix(q["x"]), _matrix(p["x"])
            weight, ids = p["w"].to_numpy(), p["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            for start in range(0, len(qs), 512):
                close = _distances(qs[start:start + 512], ps) <= eps
                hit = close.any(axis=1)
                if what == "count":
                    value = (close * weight).sum(axis=1)
                else:
                    value = ids[order][close[:, order].argmax(axis=1)]
                out.append(pd.DataFrame({"id": q["id"].to_numpy()[start:start + 512][hit], "value": value[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "value": []})

    result = "long" if what == "count" else kind
    return left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInPandas(compare, f"id {kind}, value {result}")


def _box_distance(a: str, b: str, d: int, size: float) -> Column:
    gaps = [F.greatest(F.abs(F.col(a)[i] - F.col(b)[i]) - 1, F.lit(0)).cast("double") * F.lit(size) for i in range(d)]
    return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


def _point_distance(a: str, b: str, d: int) -> Column:
    return F.sqrt(sum(((F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(d)), F.lit(0.0)))


def _touching(core: DataFrame, side: float, eps: float, d: int, max_levels: int = 50) -> DataFrame:
    """(ca, cb): pairs of cells with core points within eps of each other."""
    offsets = [o for o in _around(side, eps, d) if o > tuple([0] * d)]
    around = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])

    factor = 4 if d <= 2 else 2

    def boxes(level: int) -> DataFrame:
        """One row per occupied box: its cell, a point, the number of points."""
        box = _cell(F.col("x"), side / factor ** level, d)
        return core.withColumn("box", box).groupBy("cell", "box").agg(
            F.min_by("x", "id").alias("point"), F.count(F.lit(1)).alias("n"))

    def sided(t: DataFrame, tag: str) -> DataFrame:
        return t.select(F.col("cell").alias(f"c{tag}"), F.col("box").alias(f"b{tag}"), F.col("point").alias(f"p{tag}"), F.col("n").alias(f"n{tag}"))

    top = boxes(0)
    pairs = sided(top, "a").withColumn("cb", F.explode(F.transform(
        around, lambda o: F.zip_with(F.col("ca"), o, lambda u, v: u + v)))).join(sided(top, "b"), "cb")
    found = None
    for level in range(max_levels):
        size = side / factor ** level
        judged = pairs.withColumn("close", _point_distance("pa", "pb", d) <= eps).where(
            F.col("close") | (_box_distance("ba", "bb", d, size) <= eps * (1 + 1e-9))).checkpoint()
        hits = judged.where("close").select("ca", "cb").distinct()
        found = hits if found is None else found.union(hits)
        # Decided cell pairs drop out; boxes with one point each are decided as well.
        open_pairs = judged.join(hits, ["ca", "cb"], "left_anti").where("na > 1 or nb > 1").select("ca", "cb", "ba", "bb")
        if open_pairs.isEmpty():
            break
        finer = boxes(level + 1)
        a, b = sided(finer, "a"), sided(finer, "b")
        a = a.withColumn("ua", F.transform("ba", lambda v: F.floor(v / factor).cast("long")))
        b = b.withColumn("ub", F.transform("bb", lambda v: F.floor(v / factor).cast("long")))
        pairs = open_pairs.select("ca", "cb", F.col("ba").alias("ua"), F.col("bb").alias("ub")).join(a, ["ca", "ua"]).join(
            b, ["cb", "ub"]).select("ca", "cb", "ba", "bb", "pa", "pb", "na", "nb")
    else:
        raise RuntimeError("points too close to tell apart")
    return found.distinct()
