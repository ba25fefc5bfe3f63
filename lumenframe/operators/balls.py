"""Density clusters in any number of columns, on balls instead of a grid.

A grid has too many cells around a cell once there are more than a few columns. Here points
go to the nearest of some pivots, a pivot's cell is cut into chunks of bounded size, and every
chunk is covered by balls of radius eps / 2. Two points of a ball are neighbours, so a ball
with ``min_samples`` points needs no distance at all. The others count their chunk first, and
only those that find too few there visit the cells that the triangle inequality leaves open.
Balls whose first points are close are linked with those of the nearest cells first. Of two
clusters that are left, the balls of the smaller visit the cells of the larger, and single points
are compared only between balls that can touch. A dense cluster costs its balls, not the pairs
of its points, and the largest one visits nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenframe.operators.components import connected_components
from lumenframe.operators.neighbours import MOST_TASKS, PIVOTS, SLACK, TASK_WORK, _blocks, _distances, _matrix, _pivots, _with_cell

# Rows that a task hands on at once, and rows compared with a chunk at once.
HANDED = 50_000
COMPARED = 512
# Cells whose balls a ball is compared with before clusters are known.
NEAREST = 5


def _int_map(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(int(v)) for pair in values.items() for v in pair])


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _spread(df: DataFrame, work: int, *names: str) -> DataFrame:
    """The rows dealt by ``names`` to as many tasks as their distances need: planners count bytes only."""
    tasks = min(MOST_TASKS, -(-int(work) // TASK_WORK))
    return df.repartition(tasks, *names) if tasks > 1 else df


class Cells:
    """The cells of some pivots: which of them a point must visit, in how many chunks and blocks."""

    def __init__(self, points: DataFrame, pivots: int | None, chunk_rows: int):
        count = points.count()
        if pivots is None:
            pivots = int(min(PIVOTS[1], max(PIVOTS[0], count ** 0.5)))
        self.centres, self.chunk_rows = _pivots(points.select("x"), pivots), chunk_rows
        placed = _with_cell(_spread(points, count * len(self.centres), "x"), self.centres).checkpoint()
        # One row per pivot: bounded by PIVOTS.
        facts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"),
                                           F.min("away").alias("inner")).orderBy("cell").collect()
        self.ids = np.array([r["cell"] for r in facts], dtype=int)
        self.radius, self.inner = np.array([r["radius"] for r in facts]), np.array([r["inner"] for r in facts])
        self.rows = {r["cell"]: r["n"] for r in facts}
        self.chunks = {r["cell"]: max(1, -(-r["n"] // chunk_rows)) for r in facts}
        chunk = F.pmod(F.xxhash64("x", F.lit(1)), _int_map(self.chunks)[F.col("cell")]).cast("int")
        self.placed = placed.drop("away").withColumn("chunk", chunk)
        # Comparisons inside chunks.
        self.work = sum(n * n // self.chunks[c] for c, n in self.rows.items())

    def _visits(self, few: DataFrame, nearest: int | None = None, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """A row of ``few`` (x, reach, ...) for each cell that can hold a point within its reach: all of them,
        the ``nearest``, or those that ``only`` keeps."""
        near, ids, radius, inner = self.centres[self.ids], self.ids, self.radius, self.inner

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in _blocks(batches, len(ids)):
                if not len(batch):
                    continue
                away, reach = _distances(_matrix(batch["x"]), near), batch["reach"].to_numpy()[:, None]
                low = np.maximum(away - radius[None, :], inner[None, :] - away)
                meets = low <= reach + SLACK * (reach + away)
                if nearest is not None and nearest < len(ids):
                    away[~meets] = np.inf
                    meets &= away <= np.partition(away, nearest - 1, axis=1)[:, nearest - 1:nearest]
                rows, hits = np.nonzero(meets)
                for start in range(0, len(rows), HANDED):
                    part = slice(start, start + HANDED)
                    yield batch.iloc[rows[part]].assign(to=ids[hits[part]].astype("int32"))
        visits = _spread(few, few.count() * len(ids), "x").mapInPandas(visit, f"{_kinds(few)}, to int")
        return (only(visits) if only else visits).checkpoint()

    def meet(self, few: DataFrame, many: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
             schema: str, nearest: int | None = None, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """``compare`` of the rows of ``few`` that visit a chunk with the chunk's rows of ``many``.

        Both have x, cell and chunk, ``few`` also reach. Visitors come in blocks of bounded size.
        ``nearest`` and ``only`` leave out visits.
        """
        visits = self._visits(few, nearest, only)
        load = {r["to"]: r["n"] for r in visits.groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()}
        chunk_count = _int_map(self.chunks)
        block_count = _int_map({int(c): max(1, -(-load.get(int(c), 0) // self.chunk_rows)) for c in self.ids})
        left = visits.withColumn("to_chunk", F.explode(F.sequence(F.lit(0), chunk_count[F.col("to")] - 1)))
        left = left.withColumn("block", F.pmod(F.xxhash64("x", F.lit(2)), block_count[F.col("to")]).cast("int"))
        right = many.withColumnRenamed("cell", "to").withColumnRenamed("chunk", "to_chunk").withColumn(
            "block", F.explode(F.sequence(F.lit(0), block_count[F.col("to")] - 1)))
        # New identities, as cogrouping tables of one origin needs.
        place, work = ["to", "to_chunk", "block"], sum(n * self.rows[c] for c, n in load.items())
        left, right = (_spread(t.select(*[F.col(c).alias(c) for c in t.columns]), work, *place) for t in (left, right))
        return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(
            lambda q, p: compare(q, p) if len(q) and len(p) else pd.DataFrame(), schema)


def _cover(half: float, eps: float, min_samples: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Balls of a chunk: the smallest id that no ball holds opens the next one. ``held`` is the weight of a point's
    ball or, where that is not enough, its weight within eps in the chunk."""
    def cover(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        x, rest = _matrix(part["x"]), np.arange(len(part))
        ball, weight, number = np.empty(len(part), dtype="int32"), part["w"].to_numpy(), 0
        held = np.empty(len(part), dtype="int64")
        while len(rest):
            mine = _distances(x[rest[:1]], x[rest])[0] <= half
            ball[rest[mine]], held[rest[mine]] = number, weight[rest[mine]].sum()
            rest, number = rest[~mine], number + 1
        thin = np.flatnonzero(held < min_samples)
        for s in range(0, len(thin), COMPARED):
            held[thin[s:s + COMPARED]] = ((_distances(x[thin[s:s + COMPARED]], x) <= eps) * weight).sum(axis=1)
        return part.assign(ball=ball, held=held)
    return cover


def _count(eps: float):
    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        xs, ps, weight = _matrix(q["x"]), _matrix(p["x"]), p["w"].to_numpy()
        near = np.concatenate([((_distances(xs[s:s + COMPARED], ps) <= eps) * weight).sum(axis=1) for s in range(0, len(xs), COMPARED)])
        return pd.DataFrame({"id": q["id"].to_numpy(), "value": near})[near > 0]
    return compare


def _first(eps: float):
    """The smallest id within eps."""
    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")
        xs, ps, ids, out = _matrix(q["x"]), _matrix(p["x"]), p["id"].to_numpy(), []
        for s in range(0, len(xs), COMPARED):
            close = _distances(xs[s:s + COMPARED], ps) <= eps
            hit = close.any(axis=1)
            out.append(pd.DataFrame({"id": q["id"].to_numpy()[s:s + COMPARED][hit], "value": ids[close.argmax(axis=1)[hit]]}))
        return pd.concat(out)
    return compare


def _forest(eps: float):
    """Links of first points within eps that keep their balls together: fewer than there are balls, not all pairs."""
    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        xs, ps, names, out = _matrix(q["x"]), _matrix(p["x"]), p["node"].to_numpy(), []
        group = np.arange(len(p))
        for s in range(0, len(xs), COMPARED):
            close = _distances(xs[s:s + COMPARED], ps) <= eps
            for node, hit in zip(q["node"].to_numpy()[s:s + COMPARED], close):
                groups, at = np.unique(group[hit], return_index=True)
                out += [(node, names[i]) for i in np.flatnonzero(hit)[at]]
                if len(groups) > 1:
                    group[np.isin(group, groups)] = groups[0]
        return pd.DataFrame(out, columns=["a", "b"])
    return compare


def _open(eps: float):
    """Visiting balls that can touch a ball of another cluster in the chunk: one row for each chunk."""
    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        xs, ps, wide, label, out = _matrix(q["x"]), _matrix(p["x"]), p["r"].to_numpy(), p["label"].to_numpy(), []
        for s in range(0, len(xs), COMPARED):
            part = q.iloc[s:s + COMPARED]
            reach = part["reach"].to_numpy()[:, None] + wide[None, :]
            can = _distances(xs[s:s + COMPARED], ps) <= reach * (1 + SLACK)
            out.append(part[(can & (part["label"].to_numpy()[:, None] != label[None, :])).any(axis=1)])
        return pd.concat(out)[["node", "to", "to_chunk"]]
    return compare


def _bridges(eps: float):
    """Links of clusters with points within eps of each other; clusters linked before in the task are not compared again."""
    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        ps, other, out = _matrix(p["x"]), p["label"].to_numpy(), []
        names, group = np.unique(np.concatenate([q["label"].to_numpy(), other]), return_inverse=True)
        joined, of = np.arange(len(names)), group[len(q):]
        for node, ball in q.groupby("node", sort=True):
            xs, own = _matrix(ball["x"]), int(np.searchsorted(names, ball["label"].iloc[0]))
            wide = _distances(xs[:1], xs).max()
            near = np.flatnonzero(_distances(xs[:1], ps)[0] <= (eps + wide) * (1 + SLACK))
            for s in range(0, len(xs), COMPARED):
                near = near[joined[of[near]] != joined[own]]
                if not len(near):
                    break
                for found in np.unique(of[near[(_distances(xs[s:s + COMPARED], ps[near]) <= eps).any(axis=0)]]):
                    if joined[found] != joined[own]:
                        out.append((names[own], names[found]))
                        joined[joined == joined[found]] = joined[own]
        return pd.DataFrame(out, columns=["a", "b"])
    return compare


def ball_labels(places: DataFrame, eps: float, min_samples: int, chunk_rows: int, pivots: int | None = None) -> DataFrame:
    """(id, label): the smallest core id of a point's cluster; noise has no row.

    ``places`` has different points x with weight w and smallest id. Links are exact.
    """
    if places.isEmpty():
        return places.select("id", F.col("id").alias("label"))
    cells = Cells(places, pivots, chunk_rows)
    kind = places.schema["id"].dataType.simpleString()
    covered = _spread(cells.placed, cells.work, "cell", "chunk").groupBy("cell", "chunk").applyInPandas(
        _cover(eps / 2 * (1 - 1e-12), eps, min_samples), f"{_kinds(cells.placed)}, ball int, held long").checkpoint()
    reach = F.lit(float(eps)).alias("reach")
    point = ["id", "x", "w", "cell", "chunk", "ball"]
    poor = covered.where(F.col("held") < min_samples).select(*point)
    totals = cells.meet(poor.select("id", "x", "cell", "chunk", reach), covered.select("x", "w", "cell", "chunk"),
                        _count(eps), "id " + kind + ", value long").groupBy("id").agg(F.sum("value").alias("near")).checkpoint()
    core = covered.where(F.col("held") >= min_samples).select(*point).union(
        poor.join(totals.where(F.col("near") >= min_samples).select("id"), "id").select(*point))
    # A ball is part of a chunk, so its window is bounded.
    ball = W.partitionBy("cell", "chunk", "ball")
    core = core.withColumn("node", F.min("id").over(ball)).withColumn("first", F.min_by("x", "id").over(ball)).checkpoint()
    apart = F.sqrt(F.aggregate(F.zip_with("x", "first", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    balls = core.groupBy("cell", "chunk", "node").agg(F.first("first").alias("x"), F.max(apart).alias("r")).checkpoint()
    links = cells.meet(balls.select("node", "x", "cell", "chunk", reach), balls.select("node", "x", "cell", "chunk"),
                       _forest(eps), f"a {kind}, b {kind}", nearest=NEAREST)
    rough = connected_components(balls.select("node"), links).withColumnRenamed("component", "label").checkpoint()
    # Of two clusters that may touch, the one of fewer balls visits the other; the largest visits nothing.
    sizes = rough.groupBy("label").agg(F.count(F.lit(1)).alias("size")).checkpoint()
    named = balls.join(rough, "node").join(sizes, "label").checkpoint()
    size = F.struct("size", "label")
    tops = F.broadcast(named.groupBy(F.col("cell").alias("to")).agg(F.max(size).alias("top")))     # a row for each cell
    largest = sizes.agg(F.max(size).alias("top")).select("top.label").first()["label"]
    asked = cells.meet(named.where(F.col("label") != F.lit(largest)).select(
        "node", "x", "label", "size", "cell", "chunk", (F.lit(float(eps)) + F.col("r")).alias("reach")),
        named.select("x", "r", "label", "cell", "chunk"), _open(eps), f"node {kind}, to int, to_chunk int",
        only=lambda visits: visits.join(tops, "to").where(size < F.col("top")).drop("top")).distinct().checkpoint()
    labelled = core.join(rough, "node").select("node", "label", "x", "cell", "chunk")
    sent = asked.join(labelled.select("node", "label", "x"), "node")
    places_asked = sent.groupBy("to", "to_chunk").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("blocks"))
    left = sent.join(places_asked, ["to", "to_chunk"]).select(
        "node", "label", "x", "to", "to_chunk", F.pmod(F.xxhash64("x", F.lit(2)), F.col("blocks")).cast("int").alias("block"))
    right = labelled.withColumnsRenamed({"cell": "to", "chunk": "to_chunk"}).join(places_asked, ["to", "to_chunk"]).select(
        "label", "x", "to", "to_chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    left, right = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (left, right))
    place, bridge = ["to", "to_chunk", "block"], _bridges(eps)
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(
        lambda q, p: bridge(q, p) if len(q) and len(p) else pd.DataFrame(), f"a {kind}, b {kind}").distinct()
    whole = connected_components(rough.select(F.col("label").alias("node")).distinct(), found)
    clusters = rough.join(whole.select(F.col("node").alias("label"), "component"), "label").select("node", F.col("component").alias("label"))
    core_label = core.join(clusters, "node").select("id", "label")
    # A point that is alone within eps has no core point there.
    border = poor.join(totals.where(F.col("near") < min_samples), "id").where(F.col("near") > F.col("w")).select("id", "x", "cell", "chunk", reach)
    near_core = cells.meet(border, core.select("id", "x", "cell", "chunk"), _first(eps), f"id {kind}, value {kind}").groupBy(
        "id").agg(F.min("value").alias("core"))
    return core_label.union(near_core.join(core_label.withColumnRenamed("id", "core"), "core").select("id", "label"))
