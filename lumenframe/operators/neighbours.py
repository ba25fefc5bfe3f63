"""Exact nearest neighbours as a partitioned join, and what is built on it.

Points are assigned to the nearest of some sampled pivots. The distances of a query to the
pivots bound its k-th neighbour from above and every cell from below, so a query visits
only cells that can hold a neighbour. Cells are cut into chunks of bounded size, a task
sees one chunk and a bounded block of queries, and returns k candidates per query, never
all pairs. Points with the same coordinates are folded first: a group of copies costs one
point.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lumenframe.functions.columns import col, is_numeric, number, numeric_columns, require
from lumenframe.operators.quantiles import column_quantiles
from lumenframe.operators.ranks import lookup
from lumenframe.session import ensure_checkpoint_dir

# Pivots grow with the square root of the points, within these limits.
PIVOTS = (16, 4_096)
CHUNK_ROWS = 20_000
# Numbers held at once by a task that compares rows with pivots.
HELD = 4_000_000
# Gap patterns with cells of their own in an imputation, and visits that a task hands on at once.
MAX_PATTERNS = 1_024
VISITS = 50_000
# Distances held at once by a task that compares queries with a chunk.
COMPARED = 1_000_000
# Distances that a task of a join finds in all, about.
TASK_WORK = 2_000_000
MOST_TASKS = 20_000
SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, by differences: equal points are exactly 0 apart."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=float)


def _pivots(points: DataFrame, count: int) -> np.ndarray:
    """The ``count`` points with the smallest hashes; the sample does not grow with the table."""
    rows = points.orderBy(F.xxhash64("x"), "x").limit(count).collect()
    return np.array([r["x"] for r in rows], dtype=float)


def _blocks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Pieces of the batches small enough to compare with ``width`` numbers per row."""
    rows = max(1, HELD // max(width, 1))
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start:start + rows]


def _with_cell(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _blocks(batches, len(pivots)):
            if len(batch):
                dist = _distances(_matrix(batch["x"]), pivots)
                cell = dist.argmin(axis=1)
                yield batch.assign(cell=cell.astype("int32"), away=dist[np.arange(len(batch)), cell])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(assign, f"{schema}, cell int, away double")


def _nearest_hits(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what can be among the k nearest by (distance, id), columns being in the order of their ids:
    all that is nearer than the k-th distance, and of the ties at it the first k."""
    limit = np.partition(dist, k - 1, axis=1)[:, k - 1]
    rows, hits = np.nonzero(dist <= limit[:, None])
    tied = dist[rows, hits] == limit[rows]
    before = np.cumsum(tied) - tied     # ties up to here, less those of the rows before
    first = np.searchsorted(rows, rows)
    kept = ~tied | (before - before[first] < k)
    return rows[kept], hits[kept]


def _dealt(left: DataFrame, right: DataFrame, work: float) -> tuple[DataFrame, DataFrame]:
    """Both tables over as many tasks as their distances need: planners count bytes only, and would take a few."""
    tasks = min(MOST_TASKS, -(-int(work) // TASK_WORK))
    if tasks <= left.sparkSession.sparkContext.defaultParallelism:
        return left, right
    return left.repartition(tasks, "cell", "chunk", "block"), right.repartition(tasks, "cell", "chunk", "block")


def _by_id(p: pd.DataFrame) -> pd.DataFrame:
    """Places in the order of their smallest ids."""
    return p.iloc[np.argsort(np.array([ids[0] for ids in p["ids"]]), kind="stable")]


def knn_join(queries: DataFrame, points: DataFrame, k: int, pivots: int | None = None, chunk_rows: int = CHUNK_ROWS,
             exclude_self: bool = False) -> DataFrame:
    """(query, neighbour, distance) for the k nearest points of every query; ties by smaller id.

    Both tables have columns id and x (array of doubles, no nulls). With ``exclude_self`` a
    point with the query's own id does not count. Tables that are read again are written to
    the checkpoint folder; the result has k rows per query.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    wanted = k + 1 if exclude_self else k
    # Copies: the result depends on the coordinates, and only the first ids of a place can be among the k nearest.
    first = W.partitionBy("x").orderBy("id")
    places = points.withColumn("__row", F.row_number().over(first)).where(F.col("__row") <= wanted)
    folded = places.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 0)
    if pivots is None:
        pivots = int(min(PIVOTS[1], max(PIVOTS[0], points.count() ** 0.5)))
    centres = _pivots(folded.select("x"), pivots)
    if not len(centres):
        return queries.select(F.col("id").alias("query"), F.col("id").alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    placed = _with_cell(folded, centres).checkpoint()
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.min("away").alias("inner")).collect()
    chunks = {r["cell"]: max(1, -(-r["n"] // chunk_rows)) for r in cells}
    near = placed.select("cell", "away", F.size("ids").alias("m")).withColumn(
        "__row", F.row_number().over(W.partitionBy("cell").orderBy("away"))).where(F.col("__row") <= wanted).collect()
    ids = np.array(sorted(chunks))
    radius = np.array([next(r["radius"] for r in cells if r["cell"] == c) for c in ids])
    inner = np.array([next(r["inner"] for r in cells if r["cell"] == c) for c in ids])
    near_cell = np.array([r["cell"] for r in near])
    near_away, near_count = np.array([r["away"] for r in near]), np.array([r["m"] for r in near])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _blocks(batches, len(near_cell)):
            to_pivot = _distances(_matrix(batch["x"]), centres)
            # A cell's point at distance a from its pivot is at most |q - pivot| + a away.
            reach = to_pivot[:, near_cell] + near_away[None, :]
            # Each counts at least one point, so the ``wanted`` nearest of them are enough.
            least = np.argpartition(reach, wanted - 1, axis=1)[:, :wanted] if reach.shape[1] > wanted else np.tile(np.arange(reach.shape[1]), (len(batch), 1))
            order = np.take_along_axis(least, np.argsort(np.take_along_axis(reach, least, 1), axis=1), 1)
            reached = np.cumsum(near_count[order], axis=1) >= wanted
            at = np.where(reached.any(axis=1), reached.argmax(axis=1), order.shape[1] - 1)
            bound = np.where(reached.any(axis=1), np.take_along_axis(reach, order, 1)[np.arange(len(batch)), at], np.inf)
            low = np.maximum(to_pivot[:, ids] - radius[None, :], inner[None, :] - to_pivot[:, ids])
            rows, hits = np.nonzero(low <= bound[:, None] * (1 + SLACK) + SLACK)
            yield pd.DataFrame({"x": batch["x"].to_numpy()[rows], "cell": ids[hits].astype("int32")})

    asked = queries.select("x").distinct()
    visits = asked.mapInPandas(visit, "x array<double>, cell int").checkpoint()
    count_of = F.create_map(*[v for c, n in chunks.items() for v in (F.lit(int(c)), F.lit(int(n)))])
    sent = visits.withColumn("chunk", F.explode(F.sequence(F.lit(0), count_of[F.col("cell")] - 1)))
    # Queries of a cell are cut into blocks as well, so that neither side of a task is unbounded.
    load = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).collect()
    blocks = {r["cell"]: max(1, -(-r["q"] // chunk_rows)) for r in load}
    block_of = F.create_map(*[v for c in chunks for v in (F.lit(int(c)), F.lit(int(blocks.get(c, 1))))])
    left = sent.withColumn("block", F.pmod(F.xxhash64("x"), block_of[F.col("cell")]).cast("int"))
    right = placed.withColumn("chunk", F.pmod(F.xxhash64("x", F.lit(1)), count_of[F.col("cell")]).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), block_of[F.col("cell")] - 1))).select("cell", "chunk", "block", "x", "ids")

    size = {r["cell"]: r["n"] for r in cells}
    left, right = _dealt(left, right, sum(r["q"] * size[r["cell"]] for r in load))

    def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"x": [], "ids": [], "distance": []}, dtype=object)
        p = _by_id(p)
        qs, ps, kept = _matrix(q["x"]), _matrix(p["x"]), min(wanted, len(p))
        out, step = [], max(1, COMPARED // len(ps))
        for start in range(0, len(qs), step):
            dist = _distances(qs[start:start + step], ps)
            rows, hits = _nearest_hits(dist, kept)
            out.append(pd.DataFrame({"x": q["x"].to_numpy()[start + rows], "ids": p["ids"].to_numpy()[hits], "distance": dist[rows, hits]}))
        return pd.concat(out)

    id_type = points.schema["id"].dataType.simpleString()
    found = left.groupBy("cell", "chunk", "block").cogroup(right.groupBy("cell", "chunk", "block")).applyInPandas(
        nearest, f"x array<double>, ids array<{id_type}>, distance double")
    one = found.select("x", "distance", F.explode("ids").alias("neighbour"))
    best = one.withColumn("__row", F.row_number().over(W.partitionBy("x").orderBy("distance", "neighbour"))).where(
        F.col("__row") <= wanted).groupBy("x").agg(F.collect_list(F.struct("distance", "neighbour")).alias("near")).checkpoint()    # looked up three times
    out = lookup(queries.select("id", "x"), best, ["x"], ["near"]).select(
        F.col("id").alias("query"), F.explode("near").alias("z")).select("query", F.col("z.neighbour").alias("neighbour"), F.col("z.distance").alias("distance"))
    if exclude_self:
        out = out.where(F.col("query") != F.col("neighbour"))
        rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbour"))
        out = out.withColumn("__row", rank).where(F.col("__row") <= k).drop("__row")
    return out.checkpoint()


def _points(df: DataFrame, key: str, columns: Sequence[str], shift: Sequence[tuple[float, float]]) -> DataFrame:
    return df.select(col(key).alias("id"), F.array(*[
        (number(df, c) - F.lit(float(m))) / F.lit(float(s) or 1.0) + F.lit(0.0) for c, (m, s) in zip(columns, shift)]).alias("x"))


def _scales(df: DataFrame, columns: Sequence[str], scale: bool) -> list[tuple[float, float]]:
    if not scale:
        return [(0.0, 1.0)] * len(columns)
    row = df.agg(*[x for c in columns for x in (F.avg(number(df, c)), F.stddev_pop(number(df, c)))]).first()
    return [(row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i in range(len(columns))]


def knn_predict(train: DataFrame, queries: DataFrame, key: str, columns: Sequence[str], target: str, k: int = 5,
                scale: bool = True, **join) -> DataFrame:
    """Prediction per query: mean of the k nearest targets, or their most frequent class (smallest on ties)."""
    require(train, [key, target, *columns])
    known = train.dropna(subset=[target, *columns])
    shift = _scales(known, columns, scale)
    near = knn_join(_points(queries.dropna(subset=list(columns)), key, columns, shift), _points(known, key, columns, shift), k, **join)
    # Many queries can share a neighbour, so the target is looked up with hot keys set apart.
    voted = lookup(near, known.select(col(key).alias("neighbour"), col(target).alias("__y")), ["neighbour"], ["__y"])
    if is_numeric(train, target):
        answer = voted.groupBy("query").agg(F.avg("__y").alias("prediction"))
    else:
        votes = voted.groupBy("query", "__y").agg(F.count(F.lit(1)).alias("n"))
        answer = votes.groupBy("query").agg(F.min_by("__y", F.struct((-F.col("n")).alias("n"), F.col("__y"))).alias("prediction"))
    return queries.join(answer, col(key) == F.col("query"), "left").drop("query")


def _nan_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances over the columns known in both rows, scaled up for the others; infinite where none is shared."""
    out, shared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        both = ~np.isnan(gap)
        out += np.where(both, gap, 0.0) ** 2
        shared += both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, np.sqrt(out) * np.sqrt(a.shape[1] / shared), np.inf)


def _box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest such distance of rows to the points of boxes (NaN where a box does not know a column)."""
    near, far, shared = (np.zeros((len(q), len(low))) for _ in range(3))
    for j in range(q.shape[1]):
        below, above = low[None, :, j] - q[:, j, None], q[:, j, None] - high[None, :, j]
        both = ~np.isnan(below)
        near += np.where(both, np.maximum(np.maximum(below, above), 0.0), 0.0) ** 2
        far += np.where(both, np.maximum(-below, -above), 0.0) ** 2
        shared += both
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.where(shared > 0, np.sqrt(q.shape[1] / shared), np.inf)
        return np.where(shared > 0, np.sqrt(near) * factor, np.inf), np.where(shared > 0, np.sqrt(far) * factor, np.inf)


def _gap_join(rows: DataFrame, d: int, k: int, pivots: int | None, chunk_rows: int) -> DataFrame:
    """(x, column, neighbour, distance, value): the k nearest rows that know the column, for every gap of the different x.

    ``rows`` has id and x, an array of d doubles with nulls for gaps. One join serves all gap patterns: the pattern is
    part of a row's cell, a cell keeps the box of its values, and box bounds hold for whatever columns are shared.
    Patterns beyond the MAX_PATTERNS most frequent share cells without bounds, which every query visits.
    """
    first = W.partitionBy("x").orderBy("id")
    places = rows.withColumn("__row", F.row_number().over(first)).where(F.col("__row") <= k)
    known = F.concat_ws("", F.transform("x", lambda v: F.when(v.isNull(), "0").otherwise("1")))
    folded = places.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("known", known).checkpoint()
    common = folded.groupBy("known").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "known").limit(MAX_PATTERNS).collect()
    total = folded.count()
    pivots = pivots or int(min(PIVOTS[1], max(PIVOTS[0], total ** 0.5)))
    centres = _pivots(folded.select("x"), pivots).reshape(-1, d)
    # Each pattern uses a share of the pivots, so there are at most pivots + MAX_PATTERNS + 1 cells.
    share = {r["known"]: max(1, pivots * r["n"] // total) for r in common}
    prefix = {p: i for i, p in enumerate(share)}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _blocks(batches, len(centres)):
            if len(batch):
                away = _nan_distances(_matrix(batch["x"]), centres)
                allowed = np.array([share.get(p, 1) for p in batch["known"]])
                away[np.arange(len(centres))[None, :] >= allowed[:, None]] = np.inf
                tag = np.array([prefix.get(p, len(prefix)) for p in batch["known"]])
                yield batch.assign(cell=(tag * len(centres) + away.argmin(axis=1)).astype("int64"))

    kind = rows.schema["id"].dataType.simpleString()
    placed = folded.mapInPandas(assign, f"x array<double>, ids array<{kind}>, known string, cell long").checkpoint()
    facts = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("m"),
        *[f(F.col("x")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(d)]).orderBy("cell").collect()
    cells, held = np.array([r["cell"] for r in facts], dtype="int64"), np.array([r["m"] for r in facts])
    low, high = (np.array([[r[f"{f}{j}"] for j in range(d)] for r in facts], dtype=float).reshape(-1, d) for f in ("min", "max"))
    mixed = cells >= len(prefix) * len(centres)
    chunks = {r["cell"]: max(1, -(-r["n"] // chunk_rows)) for r in facts}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _blocks(batches, 4 * len(cells)):
            if not len(batch):
                continue
            x = _matrix(batch["x"])
            near, far = _box_bounds(x, low, high)
            near[:, mixed], far[:, mixed] = 0.0, np.inf
            for c in range(d):
                asks, gives = np.flatnonzero(np.isnan(x[:, c])), np.flatnonzero(mixed | ~np.isnan(low[:, c]))
                if not len(asks) or not len(gives):
                    continue
                reach = far[np.ix_(asks, gives)]
                order = np.argsort(reach, axis=1, kind="stable")
                reached = np.cumsum(held[gives][order], axis=1) >= k
                at = reached.argmax(axis=1)
                bound = np.where(reached.any(axis=1), np.take_along_axis(reach, order, 1)[np.arange(len(asks)), at], np.inf)
                least = near[np.ix_(asks, gives)]
                rows_, hits = np.nonzero((least <= bound[:, None] * (1 + SLACK) + SLACK) & np.isfinite(least))
                for s in range(0, len(rows_), VISITS):
                    part = slice(s, s + VISITS)
                    yield pd.DataFrame({"x": batch["x"].to_numpy()[asks[rows_[part]]], "column": np.int32(c), "cell": cells[gives[hits[part]]]})

    asked = folded.where(F.col("known").contains("0") & F.col("known").contains("1")).select("x")
    visits = asked.mapInPandas(visit, "x array<double>, column int, cell long").checkpoint()
    load = {r["cell"]: r["q"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).collect()}
    count_of, block_of = (F.create_map(*[F.lit(int(v)) if i else F.lit(int(v)).cast("long") for p in m.items() for i, v in enumerate(p)])
                          for m in (chunks, {int(c): max(1, -(-load.get(int(c), 0) // chunk_rows)) for c in cells}))
    left = visits.withColumn("chunk", F.explode(F.sequence(F.lit(0), count_of[F.col("cell")] - 1))).withColumn(
        "block", F.pmod(F.xxhash64("x", "column"), block_of[F.col("cell")]).cast("int"))
    right = placed.where(F.size("ids") > 0).withColumn("chunk", F.pmod(F.xxhash64("x", F.lit(1)), count_of[F.col("cell")]).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), block_of[F.col("cell")] - 1))).select("cell", "chunk", "block", "x", "ids")

    left, right = _dealt(left, right, sum(load.get(r["cell"], 0) * r["n"] for r in facts))

    def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out, step = [], max(1, COMPARED // max(len(p), 1))
        p = _by_id(p) if len(p) else p
        givers = _matrix(p["x"]) if len(p) else None
        for c, asks in q.groupby("column", sort=True) if len(p) else ():
            knows = np.flatnonzero(~np.isnan(givers[:, c]))
            kept, xs = min(k, len(knows)), _matrix(asks["x"])
            for s in range(0, len(xs) if kept else 0, step):
                dist = _nan_distances(xs[s:s + step], givers[knows])
                rows_, hits = _nearest_hits(np.where(np.isfinite(dist), dist, np.nan), kept)
                out.append(pd.DataFrame({"x": asks["x"].to_numpy()[s + rows_], "column": c, "ids": p["ids"].to_numpy()[knows[hits]],
                                         "distance": dist[rows_, hits], "value": givers[knows[hits], c]}))
        return pd.concat(out) if out else pd.DataFrame()

    found = left.groupBy("cell", "chunk", "block").cogroup(right.groupBy("cell", "chunk", "block")).applyInPandas(
        nearest, f"x array<double>, column int, ids array<{kind}>, distance double, value double")
    rank = F.row_number().over(W.partitionBy("x", "column").orderBy("distance", "neighbour"))
    return found.withColumn("neighbour", F.explode("ids")).withColumn("__row", rank).where(F.col("__row") <= k).select(
        "x", "column", "neighbour", "distance", "value")


def knn_impute(df: DataFrame, key: str, columns: Sequence[str] | None = None, k: int = 5, pivots: int | None = None,
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Gaps in the numeric columns filled with the mean of the k nearest rows that know the value.

    Distances use the columns both rows know, scaled up for the ones they do not; ties go to smaller
    keys. Where no row shares a column, the column median is taken.
    """
    ensure_checkpoint_dir(df.sparkSession)
    columns = [c for c in (columns or numeric_columns(df)) if c != key]
    if not columns or df.isEmpty():
        return df
    x = F.array(*[number(df, c) + F.lit(0.0) for c in columns])
    medians = column_quantiles(df, columns, [0.5])
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), col(key).alias("id"), x.alias("x"))
    found = _gap_join(rows.select("id", "x"), len(columns), k, pivots, chunk_rows)
    fills = found.groupBy("x", "column").agg(F.avg("value").alias("v")).groupBy("x").agg(
        F.map_from_entries(F.collect_list(F.struct("column", "v"))).alias("fill")).checkpoint()    # looked up three times
    # Packed, so that untouched columns come back as they were.
    out = lookup(rows.select("row", "x"), fills, ["x"], ["fill"])
    filled = {c: F.coalesce(number(df, c), F.try_element_at("__fill", F.lit(i)), F.lit(medians[c][0])) for i, c in enumerate(columns)}
    return out.select("row.*", F.col("fill").alias("__fill")).select(*[filled.get(c, col(c)).alias(c) for c in df.columns])


def local_outlier_factor(df: DataFrame, key: str, columns: Sequence[str], neighbours: int = 20, **join) -> DataFrame:
    """(key, lof): density of the neighbours over the point's own, from the reachability of its k nearest."""
    rows = df.dropna(subset=list(columns))
    points = _points(rows, key, columns, [(0.0, 1.0)] * len(columns))
    near = knn_join(points, points, neighbours, exclude_self=True, **join)
    k_distance = near.groupBy("query").agg(F.max("distance").alias("kd"))
    reach = lookup(near, k_distance.withColumnRenamed("query", "neighbour"), ["neighbour"], ["kd"]).withColumn(
        "reach", F.greatest("kd", "distance"))
    density = reach.groupBy("query").agg((1.0 / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    ratio = lookup(near, density.select(F.col("query").alias("neighbour"), F.col("lrd").alias("other")), ["neighbour"], ["other"]).join(
        density, "query")
    out = ratio.groupBy("query").agg(F.avg(F.col("other") / F.col("lrd")).alias("lof"))
    return out.withColumnRenamed("query", key)


def flag_highest(scores: DataFrame, score: str, contamination: float = 0.05) -> DataFrame:
    """Scores above the (1 - contamination) quantile are outliers."""
    limit = column_quantiles(scores, [score], [1 - contamination])[score][0]
    return scores.withColumn("outlier", F.col(score) > F.lit(limit))
