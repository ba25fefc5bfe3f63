"""Approximate nearest neighbours with multiprobe p-stable hashing.

A table's hash of a vector is the cell of a grid over a few Gaussian projections. A query visits
its own cell and those around it, in the order of the estimated chance to hold a neighbour: the
squared distances from the query's projections to the borders that a step crosses, summed. The
candidates of all tables are merged and ranked by their exact distance. Equal vectors fold into one
with its smallest ids; cells with many vectors are split over tasks; a query whose cells hold too
few vectors is compared with all rows, in blocks.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lumenframe.llm.tables import written
from lumenframe.llm.vectors import rows_of

TABLES, PROJECTIONS, PROBES = 6, 6, 36
WIDTH = 2.0             # of a cell, in standard deviations of a projection
SAMPLE = 2_000          # vectors from which the spread is measured
CELL_ROWS = 20_000      # vectors of a cell in one task; more are dealt to several
TASK_ROWS = 100_000     # rows of all tables in one task, about
STEPS = np.array(list(itertools.product((-1, 0, 1), repeat=PROJECTIONS)))


class Grid:
    """The tables' projections for one length of vectors."""

    def __init__(self, dim: int, centre: np.ndarray, spread: float, seed: int = 17):
        rng = np.random.default_rng([seed, dim])
        self.lines = rng.standard_normal((TABLES, dim, PROJECTIONS)) / (spread * WIDTH)
        self.shift = rng.uniform(0, 1, (TABLES, PROJECTIONS))
        self.mix = rng.integers(0, 1 << 62, (TABLES, PROJECTIONS), dtype=np.int64) * 2 + 1
        self.centre, self.dim = centre, dim

    def places(self, x: np.ndarray) -> np.ndarray:
        """Table, vector, projection."""
        return np.clip((x - self.centre) @ self.lines + self.shift[:, None, :], -1e15, 1e15)

    def number(self, table: int, cells: np.ndarray) -> np.ndarray:
        """One number for each cell of a table; two cells with the same one only add candidates."""
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mix[table]).sum(axis=-1) * 64 + table * 1_000_003 + self.dim

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        cells = np.floor(self.places(x))
        return np.stack([self.number(t, cells[t]) for t in range(TABLES)], axis=1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """For each vector the cells to visit, best first in each table."""
        places = self.places(x)
        cells, out = np.floor(places), []
        for t in range(TABLES):
            inside = places[t] - cells[t]
            cost = np.stack([inside ** 2, np.zeros_like(inside), (1 - inside) ** 2], axis=-1)  # one down, stay, one up
            score = sum(cost[:, m, STEPS[:, m] + 1] for m in range(PROJECTIONS))
            best = np.argsort(score, axis=1, kind="stable")[:, :PROBES]
            out.append(self.number(t, cells[t][:, None, :] + STEPS[best]))
        return np.concatenate(out, axis=1)


def best_of(query: str, x: np.ndarray, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(query, key, distance, ids) of the nearest distinct vectors, ties to the smaller id: as many as leave ``k``
    to every id that asks, whose own vectors are none."""
    distance = np.sqrt(((rows - x) ** 2).sum(axis=1))
    near = np.arange(len(distance))
    if len(distance) > k + 1:
        near = np.flatnonzero(distance <= np.partition(distance, k)[k])
    for some in (near, np.arange(len(distance))):  # ids with several vectors can need more than the k + 1 nearest
        kept, often = [], Counter()
        for i in sorted(some, key=lambda i: (distance[i], ids[i][0], keys[i])):
            alone = ids[i][0] == ids[i][-1]
            if alone and often[ids[i][0]] == k:
                continue
            often[ids[i][0]] += alone
            kept.append((query, keys[i], float(distance[i]), ids[i]))
            if len(kept) - max(often.values()) >= k:
                return kept
    return kept


FOUND = "query string, key string, distance double, ids array<long>"


def found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["query", "key", "distance", "ids"])


def vectors(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def nearest(table: DataFrame, every: int = 100, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id is divisible by ``every``.

    ``score`` is the Euclidean distance of the original vectors in double precision; ranks start at
    1, ties go to the smaller id. All rows but those with the query's own id are candidates; every
    row is indexed. Vectors that are null, zero or hold null or non-finite numbers, and rows with a
    null id, take no part; vectors of different lengths do not meet. Rows that repeat an id are
    candidates each. A query with fewer than ``k`` candidates in all gets them all. An empty table
    gives no rows. Other columns are left out.
    """
    spark = table.sparkSession
    rows = written(rows_of(table, id, vector), "ann-rows")
    # Of equal vectors no query can need more than its k and its own; the limit is kept before the shuffle.
    low = rows.select("key", "vec").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("vec"))).where(F.col("n") <= k + 1)
    ids = low.groupBy("key").agg(F.array_sort(F.collect_list("vec")).alias("ids"))
    folded = rows.groupBy("key").agg(F.first("v").alias("v")).join(ids, "key")
    asked = rows.where(F.col("vec") % every == 0).select(F.col("key").alias("query"), F.col("vec").alias("query_id")).distinct()

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = [np.asarray(v, np.float64).tobytes() for v in frame["v"]]
            yield pd.DataFrame({"key": frame["key"], "dim": frame["v"].map(len), "raw": raw, "ids": frame["ids"]})

    folded = written(folded.mapInPandas(pack, "key string, dim int, raw binary, ids array<long>"), "ann-folded")
    sizes = {r["dim"]: r["count"] for r in folded.groupBy("dim").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    grids = {}
    for dim in sorted(sizes):
        sample = np.stack([np.frombuffer(r.raw, np.float64) for r in folded.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("raw").collect()])
        centre = np.median(sample, axis=0)
        # The spread of a projection; the median keeps far outliers from widening the cells.
        spread = float(np.median(np.linalg.norm(sample - centre, axis=1))) or float(np.linalg.norm(sample - centre, axis=1).max()) or 1.0
        grids[dim] = Grid(dim, centre, spread)
    shared = spark.sparkContext.broadcast(grids)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                for at in range(0, len(part), 2048):
                    some = part.iloc[at:at + 2048]
                    cells = shared.value[dim].own(vectors(some["raw"]))
                    yield pd.DataFrame({"cell": cells.reshape(-1)} | {c: np.repeat(some[c].to_numpy(object), TABLES) for c in ("key", "raw", "ids")})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                for at in range(0, len(part), 256):
                    some = part.iloc[at:at + 256]
                    cells = shared.value[dim].probes(vectors(some["raw"]))
                    yield pd.DataFrame({"cell": cells.reshape(-1), "key": np.repeat(some["key"].to_numpy(object), cells.shape[1])})

    indexed = written(folded.mapInPandas(index, "cell long, key string, raw binary, ids array<long>"), "ann-index")
    queries = written(folded.join(asked.select(F.col("query").alias("key")).distinct(), "key", "left_semi"), "ann-queries")
    crowded = written(indexed.groupBy("cell").count().where(F.col("count") > CELL_ROWS).select("cell", F.ceil(F.col("count") / CELL_ROWS).alias("parts")), "ann-crowded")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(sizes.values()) * TABLES // TASK_ROWS))
    parts = F.coalesce("parts", F.lit(1)).cast("long")
    task = F.pmod(F.xxhash64("cell", "part"), F.lit(tasks)).alias("task")
    held = indexed.join(crowded, "cell", "left").withColumn("part", F.pmod(F.xxhash64("key"), parts)).select(task, "cell", "key", "raw", "ids")
    sent = queries.select("key", "dim", "raw").mapInPandas(probe, "cell long, key string").join(crowded, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    sent = sent.select(task, "cell", "key").groupBy("task", "key").agg(F.collect_set("cell").alias("cells")).join(queries.select("key", "raw"), "key")

    def rank(probes: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(held):
            return found([])
        held = held.sort_values("cell", kind="stable", ignore_index=True)
        cell, out = held["cell"].to_numpy(), []
        code = pd.factorize(held["key"])[0]
        held["dim"] = held["raw"].map(len)
        length = held["dim"].to_numpy()
        matrix = {dim: vectors(held.loc[held["dim"] == dim, "raw"]) for dim in np.unique(length)}
        place = np.zeros(len(held), int)
        for dim in matrix:
            place[length == dim] = np.arange((length == dim).sum())
        for query in probes.itertuples():
            wanted = np.asarray(query.cells)
            a, b = np.searchsorted(cell, wanted, "left"), np.searchsorted(cell, wanted, "right")
            rows = np.concatenate([np.arange(x, y) for x, y in zip(a, b)]) 
            rows = rows[length[rows] == len(query.raw)]
            if not len(rows):
                continue
            some = matrix[len(query.raw)][place[rows]]
            first = np.unique(code[rows], return_index=True)[1]
            keys, ids = held["key"].to_numpy()[rows[first]], held["ids"].to_numpy()[rows[first]]
            out += best_of(query.key, np.frombuffer(query.raw, np.float64), some[first], keys, ids, k)
        return found(out)

    candidates = written(sent.groupBy("task").cogroup(held.groupBy("task")).applyInPandas(rank, FOUND), "ann-candidates")

    def ranked(pairs: DataFrame) -> DataFrame:
        distinct = pairs.groupBy("query", "key").agg(F.min("distance").alias("score"), F.first("ids").alias("ids"))
        # A vector of one id alone is nothing to that id, and any other needs k of its vectors at most: 2 k in all.
        alone = F.when(F.array_min("ids") == F.array_max("ids"), F.array_min("ids"))
        order = ["score", F.col("ids")[0], "key"]
        near = distinct.withColumn("alone", alone).withColumn("n", F.row_number().over(W.partitionBy("query", "alone").orderBy(*order)))
        near = near.where(F.col("alone").isNull() | (F.col("n") <= k)).withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("n") <= 2 * k)
        answers = asked.join(near, "query").select("query", "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        return answers.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    answers = written(ranked(candidates), "ann-answers")
    # Queries whose cells held too few: all rows, in blocks.
    few = asked.join(answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(f"coalesce(n, 0) < {k}").select(F.col("query").alias("key")).distinct()
    short = written(queries.join(few, "key", "left_semi"), "ann-short")
    blocks = max(1, -(-sum(sizes.values()) // TASK_ROWS))
    spread_out = short.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cells", F.array("dim")).select("task", "key", "cells", "raw")
    all_rows = folded.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("task"), F.col("dim").alias("cell"), "key", "raw", "ids")
    full = ranked(spread_out.groupBy("task").cogroup(all_rows.groupBy("task")).applyInPandas(rank, FOUND))
    kept = answers.join(short.select(F.col("key").alias("query")), "query", "left_anti")
    return kept.union(full.select(*kept.columns)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
