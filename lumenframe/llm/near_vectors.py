"""Near-duplicate vectors: spherical k-means cells, cosine products in blocks, one vector of each group.

Equal vectors fold into one. Every vector lives in the cell of its nearest centroid and visits each
earlier cell in which a partner can live: a partner lives on the other side of the plane between two
centroids, and one whose cosine reaches the threshold lies no farther from it than
sqrt(1 - threshold^2). So no link is lost, whatever the centroids. Cells are cut into blocks that
meet pairwise in tasks; a task returns a row for each vector and product, not for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.tables import written
from lumenframe.llm.vectors import rows_of, usable
from lumenframe.operators.components import connected_components

SAMPLE = 20_000         # vectors from which the centroids are learned
CELL_ROWS = 4_000       # vectors to a cell, about
MAX_CELLS = 1_024       # centroids, bounded since every task holds them
BLOCK = 8_192           # vectors of a cell that meet in one task
TILE = 1_024            # vectors of one product


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors; empty cells restart at the vectors that fit worst."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        cosine = x @ centroids.T
        home, best = cosine.argmax(axis=1), cosine.max(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        lost = np.flatnonzero(size < 1e-12)
        total[lost] = x[np.argsort(best)[:len(lost)]]
        centroids = total / np.linalg.norm(total, axis=1, keepdims=True)
    return centroids


def homes(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, cell, whether it lives there): the home of each vector and the earlier cells that it visits."""
    cosine = x @ centroids.T
    home = cosine.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    gap = (cosine[np.arange(len(x)), home][:, None] - cosine) / np.maximum(apart[home], 1e-12)
    reach = np.sqrt(max(1 - threshold ** 2, 0)) + 1e-9
    visit = (gap <= reach) & (np.arange(len(centroids)) < home[:, None])
    who, where = np.nonzero(visit)
    return np.concatenate([np.arange(len(x)), who]), np.concatenate([home, where]), np.concatenate([np.ones(len(x), bool), np.zeros(len(who), bool)])


def joined(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number that links lead each row and each column to; the numbers are theirs to start with."""
    while True:
        low_left = np.minimum(left, np.where(linked, right, np.iinfo(right.dtype).max).min(axis=1))
        low_right = np.minimum(right, np.where(linked, low_left[:, None], np.iinfo(right.dtype).max).min(axis=0))
        if (low_left == left).all() and (low_right == right).all():
            return left, right
        left, right = low_left, low_right


def meet(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """(key, low, links) for each product of tiles: the vectors with links, the smallest key that links in the tile lead to, and how many links."""
    same = right is None
    right = left if same else right
    x, y = [np.frombuffer(b"".join(f["unit"]), np.float64).reshape(len(f), -1) for f in (left, right)]
    keys = np.unique(np.concatenate([left["key"].to_numpy(str), right["key"].to_numpy(str)]))
    number = [np.searchsorted(keys, f["key"].to_numpy(str)) for f in (left, right)]
    copies = [f["copies"].to_numpy() for f in (left, right)]
    out = []
    for i in range(0, len(x), TILE):
        for j in range(i if same else 0, len(y), TILE):
            linked = x[i:i + TILE] @ y[j:j + TILE].T >= threshold
            if same and i == j:
                np.fill_diagonal(linked, False)
            rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            if not len(rows):
                continue
            linked = linked[np.ix_(rows, columns)]
            a, b = number[0][i + rows], number[1][j + columns]
            low_a, low_b = joined(linked, a, b)
            out.append(pd.DataFrame({"key": keys[a], "low": keys[low_a], "links": linked @ copies[1][j + columns]}))
            if not (same and i == j):
                out.append(pd.DataFrame({"key": keys[b], "low": keys[low_b], "links": copies[0][i + rows] @ linked}))
    # Object columns: Arrow keeps joined text columns in several chunks, which the way back to Spark does not take.
    return pd.concat(out).astype({"key": object, "low": object}) if out else pd.DataFrame({"key": [], "low": [], "links": []}).astype({"key": object, "low": object, "links": "int64"})


def near_vectors(table: DataFrame, threshold: float = 0.9, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows whose cosine reaches ``threshold`` are linked; ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id that links lead to, ``kept`` marks the row with
    that id. A vector that is null, zero or holds a null or a non-finite number, and a row with a
    null id, links with nothing and is its own component. Vectors of different lengths are not
    linked. Equal vectors are linked as copies, rows that repeat id and vector too.
    Other columns are left out; an empty table gives no rows.
    """
    rows = written(rows_of(table, id, vector), "vectors")
    folded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("vec").alias("first"), F.first("v").alias("v"))
    folded = written(folded.withColumn("dim", F.size("v")), "vectors-folded")
    sizes = {r["dim"]: r["count"] for r in folded.groupBy("dim").count().orderBy("dim").collect()}
    centroids = {}
    for dim, count in sizes.items():
        sample = folded.where(F.col("dim") == dim).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()
        x = np.array([r.v for r in sample])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centroids[dim] = spherical_kmeans(x, max(1, min(MAX_CELLS, count // CELL_ROWS)))
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                for at in range(0, len(part), TILE):
                    some = part.iloc[at:at + TILE]
                    x = np.stack(some["v"].to_numpy())
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    who, cell, lives = homes(x, shared.value[dim], threshold)
                    raw = np.array([r.tobytes() for r in x], object)
                    yield pd.DataFrame({"dim": dim, "cell": cell, "lives": lives, "key": some["key"].to_numpy()[who], "copies": some["copies"].to_numpy()[who], "unit": raw[who]})

    placed = written(folded.select("key", "copies", "v", "dim").mapInPandas(assign, "dim int, cell long, lives boolean, key string, copies long, unit binary"), "vectors-cells")
    counts = placed.groupBy("dim", "cell").agg(
        F.greatest(F.ceil(F.count(F.when(F.col("lives"), 1)) / BLOCK), F.lit(1)).cast("long").alias("own"),
        F.ceil(F.count(F.when(~F.col("lives"), 1)) / BLOCK).cast("long").alias("guests"))
    dealt = placed.join(counts, ["dim", "cell"])
    # Blocks of the cell are numbered first, blocks of visitors after them; visitors meet only the cell's own.
    block = F.when(F.col("lives"), F.pmod(F.xxhash64("key"), "own")).otherwise(F.col("own") + F.pmod(F.xxhash64("key"), F.greatest("guests", F.lit(1))))
    partners = F.when(F.col("lives"), F.sequence(F.lit(0).cast("long"), F.col("own") + F.col("guests") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("own") - 1))
    met = dealt.withColumn("block", block).withColumn("other", F.explode(partners))
    met = met.select("dim", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies", "unit")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        return meet(frame, None, threshold) if i == j else meet(frame[frame["block"] == i], frame[frame["block"] == j], threshold)

    found = written(met.groupBy("dim", "cell", "i", "j").applyInPandas(compare, "key string, low string, links long"), "vectors-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = found.where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    classes = connected_components(links.select(F.col("key").alias("node")), edges).select(F.col("node").alias("key"), "component").join(links, "key")
    known = folded.select("key", "copies", "first").join(classes, "key", "left").select(
        "key", "first", F.coalesce("component", "key").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lowest = known.groupBy("component").agg(F.min("first").alias("lowest"))
    known = known.join(lowest, "component").select("key", "n_links", "lowest")
    whole = table.select(F.col(id).cast("long").alias("vec"), F.col(vector).cast("array<double>").alias("v"))
    apart = rows_of(whole, "vec", "v").select("vec", "key").join(known, "key").select(F.col("vec").alias(id), F.col("n_links").cast("long").alias("n_links"), F.col("lowest").alias("component_id"))
    rest = whole.where(F.col("vec").isNull() | ~usable("v")).select(F.col("vec").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component_id"))
    return apart.union(rest).withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
