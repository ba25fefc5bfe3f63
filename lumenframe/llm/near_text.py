"""Near-duplicate texts: an n-gram Jaccard join with Bayesian pruning of candidates.

Texts with the same words fold into one. MinHash bands propose candidates; pairs are not written
out. Instead the texts that share bands form groups, and the groups, cut into blocks of bounded
size, meet block by block inside tasks. There a candidate pair's MinHash values are compared in
steps; it is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below a tolerance. What is left is verified on the whole sets of shingles. A task
returns one row for each text in its blocks: its links, and the smallest text it is joined to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.tables import arrow_rows, written
from lumenframe.operators.components import connected_components

BANDS, ROWS = 20, 4             # a pair at 0.8 misses every band once in 37,000
COMPARED, STEP = 64, 16         # further values for the Bayesian comparison, and how many at a time
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 1 << 19
SLAB = 4096                     # shingles verified at a time
ARROW_ROWS = 1_000              # rows handed to Python at a time
SEED = 20240229


def shingles(text: str | None, n: int) -> tuple[str | None, np.ndarray]:
    """(key of the words, sorted distinct hashes of n-word shingles). Words are lower-cased and split at
    white space; fewer than n words make one shingle, none make none and have no key."""
    words = (text or "").lower().split()
    if not words:
        return None, np.zeros(0, np.uint64)
    joined = " ".join(words).encode()
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    if len(words) < n:
        each = np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    else:
        total = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            total = (total ^ each[i:len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        each = np.unique(total)
    return xxhash.xxh3_128_hexdigest(joined), each


def minhash(hashes: np.ndarray, multiply: np.ndarray) -> np.ndarray:
    """Smallest 32-bit value of each of the hash functions."""
    low = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 512):
        mixed = hashes[at:at + 512, None] * multiply
        low = np.minimum(low, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return low


def functions() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS + COMPARED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For each step the matches below which P(similarity >= threshold) < tolerance, from a flat prior.

    After m matches in n values the posterior is Beta(m+1, n-m+1); its upper tail is the lower tail
    of a binomial with n+1 trials.
    """
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        tail, least = 0.0, n
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                least = m
                break
        out.append(least)
    return out


def describe(rows: DataFrame, n: int) -> DataFrame:
    """(doc, same, key, weight, bands, values) of (doc, same, body)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        multiply = functions()
        for frame in frames:
            for at in range(0, len(frame), 500):
                part, out = frame.iloc[at:at + 500], []
                for body in part["body"]:
                    key, own = shingles(body, n)
                    low = minhash(own, multiply)
                    head = low[:BANDS * ROWS].reshape(BANDS, ROWS)
                    bands = [xxhash.xxh3_64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(head)] if key else []
                    out.append((key, len(own), bands, low[BANDS * ROWS:].tobytes()))
                key, weight, bands, values = zip(*out)
                yield pd.DataFrame({"doc": part["doc"].array, "same": part["same"].array, "key": key, "weight": weight, "bands": bands, "values": values})

    return rows.mapInPandas(run, "doc string, same string, key string, weight long, bands array<long>, values binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each left set shares with each right set."""
    both = left + right
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, place, often = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    live = often[place] > 1
    owner, place = owner[live], place[live]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    if len(place):
        place = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]]))
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, SLAB):
        a, b = np.searchsorted(place, [first, first + SLAB])
        grid = np.zeros((len(both), min(SLAB, int(place[-1]) + 1 - first)), np.float32)
        grid[owner[a:b], place[a:b] - first] = 1
        out += grid[:len(left)] @ grid[len(left):].T
    return out


def compare(left: pd.DataFrame, right: pd.DataFrame | None, n: int, threshold: float, least: list[int]) -> Iterator[pd.DataFrame]:
    """(key, low, links) of the texts of two blocks, or of one with itself; links count copies."""
    same = right is None
    right = left if same else right
    bands = [np.stack(x["bands"].to_numpy()) for x in (left, right)]
    maybe = np.zeros((len(left), len(right)), bool)
    for k in range(BANDS):
        maybe |= bands[0][:, k, None] == bands[1][None, :, k]
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    values = [np.frombuffer(b"".join(x["values"]), np.uint32).reshape(-1, COMPARED) for x in (left, right)]
    matches = np.zeros(len(i), np.int64)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            matches[s] += (values[0][i[s], part] == values[1][j[s], part]).sum(axis=1)
        stay = matches >= need
        i, j, matches = i[stay], j[stay], matches[stay]
    if not len(i):
        return
    rows, columns = np.unique(i), np.unique(j)
    a, b = [shingles(t, n)[1] for t in left["body"].iloc[rows]], [shingles(t, n)[1] for t in right["body"].iloc[columns]]
    shared = overlaps(a, b)[np.searchsorted(rows, i), np.searchsorted(columns, j)]
    union = left["weight"].to_numpy()[i] + right["weight"].to_numpy()[j] - shared
    true = shared >= threshold * union - 1e-9 * union
    i, j = i[true], j[true]
    if not len(i):
        return
    keys = np.concatenate([left["key"].to_numpy(str), [] if same else right["key"].to_numpy(str)])
    copies = np.concatenate([left["copies"].to_numpy(), [] if same else right["copies"].to_numpy()])
    j = j + (0 if same else len(left))
    links = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
    low = np.argsort(np.argsort(keys))  # the smallest key that links inside these blocks lead to, by its rank
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        if (low == before).all():
            break
    has = links > 0
    yield pd.DataFrame({"key": keys[has], "low": np.sort(keys)[low[has]], "links": links[has].astype(np.int64)})


def near_text(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-7, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, copy_id, n_links, kept, body_md5) of every row.

    Two rows are linked when the Jaccard similarity of their sets of n-word shingles is at least
    ``threshold``. ``class_id`` is the smallest id that links lead to, ``copy_id`` the smallest id
    with the same words, ``n_links`` the number of other rows linked directly, copies included.
    ``kept`` marks the one document of each class with the smallest id. Rows without words (null,
    empty or blank texts) have no shingles and link with nothing; a null id stays null, its row is
    linked but never a class id unless its class has no other, and ``kept`` only then. Long texts are
    compared whole; an empty table gives no rows. Equal rows are copies; rows that repeat id and text are all marked as kept. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("same", F.md5("body"))
    # Through pandas the id goes as text: a null among whole numbers would make them floating point.
    with arrow_rows(spark, ARROW_ROWS):
        described = written(describe(rows.select(F.col("doc").cast("string"), "same", "body"), n).withColumn("doc", F.col("doc").cast("long")), "near-text")
    texts = (described.where("key is not null").groupBy("key")
             .agg(F.min("doc").alias("first"), F.min(F.struct("doc", "same")).alias("body_of"), F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("values").alias("values")))
    texts = written(texts, "near-text-keys")
    banded = texts.select("key", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = written(banded.join(shared, ["band", "value"]).where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct(), "near-text-bands")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    groups = connected_components(nodes, edges).select(F.col("node").alias("key"), F.col("component").alias("grp"))
    members = written(groups.join(texts.drop("first"), "key"), "near-text-groups")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long")
    dealt = members.join(sizes.select("grp", blocks.alias("blocks")), "grp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # Bodies come by id and checksum of one row of each text; only texts that share a band are asked for.
    wanted = dealt.select("key", "grp", "blocks", "block", "copies", "weight", "bands", "values", F.col("body_of.doc").alias("at"), F.col("body_of.same").alias("same"))
    bodies = rows.join(wanted, F.col("doc").eqNullSafe(F.col("at")) & (rows["same"] == wanted["same"])).select("key", "grp", "blocks", "block", "copies", "weight", "bands", "values", "body")
    bodies = bodies.dropDuplicates(["key"])
    # One task key for each pair of blocks; small groups share task keys, each about a block in all.
    small = max(1, -(-members.count() // BLOCK_TEXTS))
    met = bodies.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(small))).otherwise(F.xxhash64("grp", "i", "j"))
    least = fewest_matches(threshold, tolerance)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), part in frame.groupby(["grp", "i", "j"], sort=False):
            if i == j:
                out += compare(part, None, n, threshold, least)
            else:
                left, right = part[part["block"] == i], part[part["block"] == j]
                if len(left) and len(right):
                    out += compare(left, right, n, threshold, least)
        # Object columns: Arrow keeps joined text columns in several chunks, which the way back to Spark does not take.
        return pd.concat(out).astype({"key": object, "low": object}) if out else pd.DataFrame({"key": [], "low": [], "links": []}).astype({"key": object, "low": object, "links": "int64"})

    with arrow_rows(spark, ARROW_ROWS):
        found = written(met.withColumn("task", task).groupBy("task").applyInPandas(meet, "key string, low string, links long"), "near-text-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joins = found.where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    classes = connected_components(links.select(F.col("key").alias("node")), joins).select(F.col("node").alias("key"), F.col("component").alias("cls"))
    linked = classes.join(links, "key")
    known = texts.select("key", "first", "copies", "body_of").join(linked, "key", "left").select(
        "key", "first", "body_of", "copies", F.coalesce("cls", "key").alias("cls"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # The smallest id of each class; nulls only where it has no other.
    heads = known.groupBy("cls").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), F.col("key").alias("head"))).alias("top"))
    known = known.join(heads, "cls").select("key", "first", "n_links", F.col("top.id").alias("class"), F.col("top.head").alias("head"))
    known = written(known, "near-text-classes")
    alone = F.col("head").isNull()
    return (described.select("doc", "same", "key").join(known, "key", "left")
            .select(F.col("doc").alias(id), F.when(alone, F.col("doc")).otherwise(F.col("class")).alias("class_id"),
                    F.when(alone, F.col("doc")).otherwise(F.col("first")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    (alone | (F.col("key") == F.col("head")) & F.col("doc").eqNullSafe(F.col("class"))).alias("kept"), F.col("same").alias("body_md5")))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` with one document of each class, all columns as they are, whatever their names.

    Of rows that repeat id and text, one stays. Rows without words (null, empty or blank texts) are
    classes of their own; a null id stays only in a class without other ids. Between documents of a
    class the smallest id decides, so there are no ties. Long texts are compared whole. An empty
    table gives no rows.
    """
    kept = near_text(docs, id=id, text=text, **settings).where("kept").select(F.col(id).cast("long").alias("kept_id"), F.col("body_md5").alias("kept_md5")).distinct()
    # Columns of the input go by number, so that no helper's name can clash with theirs.
    names = {c: f"doc_column_{i}" for i, c in enumerate(docs.columns)}
    marked = docs.toDF(*names.values()).withColumn("md5", F.md5(F.coalesce(F.col(names[text]), F.lit(""))))
    joined = marked.join(kept, F.col(names[id]).cast("long").eqNullSafe(F.col("kept_id")) & (F.col("md5") == F.col("kept_md5")), "left_semi")
    return joined.dropDuplicates([names[id], "md5"]).drop("md5").toDF(*names)
