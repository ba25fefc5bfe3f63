"""Packing documents into sequences along a space-filling curve.

Every document becomes a vector of hashed token counts, projected to a few dimensions; its place
on a Hilbert curve through them is its sort key. A range partitioning by key deals the documents
out, and each range is read as one stream of ids that is cut every ``length`` ids, so neighbours
on the curve share sequences. The last, shorter rest of a range is cut into powers of two, which
need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.hilbert import hilbert_key
from lumenframe.llm.tables import arrow_rows, written
from lumenframe.llm.token_counts import vocabulary
from lumenframe.llm.transducer import compiled

BUCKETS = 1024              # hashed vector
DIMS, BITS = 3, 10          # of the curve
SPREAD = 4.0                # coordinates beyond this are moved to the border
RANGE_TOKENS = 4_000_000    # ids that one range holds, about
GROUP = 500                 # documents encoded together


def curve_place(ids: np.ndarray, sizes: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie one after the other."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    counts = np.bincount(owner * BUCKETS + bucket.astype(np.int64), minlength=len(sizes) * BUCKETS).reshape(len(sizes), BUCKETS)
    vector = np.sqrt(counts)
    vector /= np.maximum(np.sqrt((vector ** 2).sum(axis=1, keepdims=True)), 1e-12)
    spot = (vector @ projection + SPREAD) / (2 * SPREAD) * (1 << BITS)
    return hilbert_key(np.clip(spot, 0, (1 << BITS) - 1), BITS)


def encode(docs: DataFrame, path: str, end_id: int, seed: int) -> DataFrame:
    """(doc, place, size, ids) of each row of (doc, body); ids as little-endian bytes of two or four each.

    ``doc`` is text, since a null among whole numbers would turn them into floating point in pandas.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = compiled(shared.value)
        projection = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
        kind = "<u2" if len(machine.length) <= 1 << 16 else "<u4"
        for frame in frames:
            for at in range(0, len(frame), GROUP):
                part = frame.iloc[at:at + GROUP]
                ids, sizes = machine.ids(part["body"].tolist())
                place = curve_place(ids, sizes, projection)
                stop = np.cumsum(sizes)
                full = np.insert(ids, stop, end_id).astype(kind)
                edge = np.concatenate([[0], np.cumsum(sizes + 1)])
                yield pd.DataFrame({"doc": part["doc"].array, "place": place, "size": sizes + 1,
                                    "ids": [full[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]})

    return docs.mapInPandas(run, "doc string, place long, size long, ids binary")


def cut(segments: pd.DataFrame, stream: np.ndarray, bounds: np.ndarray, first_sequence: int) -> pd.DataFrame:
    """Pieces of a stream of ids: borders are the documents' and the sequences' starts."""
    size = segments["size"].to_numpy()
    begin = np.cumsum(size) - size
    at = np.union1d(begin[size > 0], bounds[:-1])
    stop = np.append(at[1:], bounds[-1])
    own = np.searchsorted(begin, at, side="right") - 1
    sequence = np.searchsorted(bounds, at, side="right") - 1
    return pd.DataFrame({
        "doc": segments["doc"].to_numpy(object)[own], "start": segments["start"].to_numpy()[own] + at - begin[own], "length": stop - at,
        "ids": [stream[a:b].tobytes() for a, b in zip(at, stop)], "doc_tokens": segments["whole"].to_numpy()[own],
        "sequence_id": first_sequence + sequence, "offset": at - bounds[sequence]})


def fill(frames: Iterator[pd.DataFrame], length: int, wide: bool) -> Iterator[pd.DataFrame]:
    """Cuts the documents of one range, in the order in which they come."""
    sequence = TaskContext.get().partitionId() << 40
    rest, kept = np.zeros(0, "<u4"), pd.DataFrame({"doc": np.zeros(0, object), "start": np.zeros(0, np.int64), "size": np.zeros(0, np.int64), "whole": np.zeros(0, np.int64)})
    for frame in frames:
        for at in range(0, len(frame), GROUP):
            part = frame.iloc[at:at + GROUP]
            new = np.frombuffer(b"".join(part["ids"]), "<u4" if wide else "<u2").astype("<u4")
            segments = pd.concat([kept, pd.DataFrame({"doc": part["doc"].to_numpy(object), "start": 0, "size": part["size"].to_numpy(), "whole": part["size"].to_numpy()})], ignore_index=True)
            stream = np.concatenate([rest, new])
            full = len(stream) // length * length
            if full:
                whole = np.cumsum(segments["size"].to_numpy())
                last = int(np.searchsorted(whole, full, side="left"))
                left = int(whole[last]) - full
                head = segments.iloc[:last + 1].copy()
                head.iloc[-1, head.columns.get_loc("size")] -= left
                yield cut(head, stream[:full], np.arange(0, full + 1, length), sequence)
                sequence += full // length
                tail = segments.iloc[last:].copy()
                tail.iloc[0, tail.columns.get_loc("start")] += int(tail.iloc[0]["size"]) - left
                tail.iloc[0, tail.columns.get_loc("size")] = left
                segments = tail if left else tail.iloc[1:]
            rest, kept = stream[full:], segments.reset_index(drop=True)
    if len(rest):
        powers = [1 << b for b in range(len(rest).bit_length() - 1, -1, -1) if len(rest) >> b & 1]
        yield cut(kept, rest, np.concatenate([[0], np.cumsum(powers)]), sequence)


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers. Each document's ids are
    followed by ``end_id``; every id lies in exactly one piece. Sequences have ``length`` ids, only
    the rest of a range a power of two below it, so nothing is padded. A null text is empty and
    gives the end id alone; a null id stays null; equal rows are packed each on its own. Copies share
    a place on the curve and are dealt out by a hash of their id. An empty table gives no rows.
    Other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("string").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    with arrow_rows(spark, GROUP):
        encoded = written(encode(rows, path, end_id, seed), "packing")
    total = encoded.agg(F.sum("size")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TOKENS))
    # The place in the high bits, a hash of the id in the low ones.
    order = F.shiftleft(F.col("place"), 32).bitwiseOR(F.xxhash64("doc").bitwiseAND(F.lit((1 << 32) - 1)))
    dealt = encoded.withColumn("order", order).repartitionByRange(ranges, "order").sortWithinPartitions("order", "doc", "size", "ids")
    shared = vocabulary_is_wide(path)
    pieces = dealt.select("doc", "size", "ids").mapInPandas(
        lambda frames: fill(frames, length, shared),
        "doc string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumn("doc", F.col("doc").cast(docs.schema[id].dataType)).withColumnRenamed("doc", id)


def vocabulary_is_wide(path: str) -> bool:
    return len(compiled(vocabulary(path)).length) > 1 << 16
