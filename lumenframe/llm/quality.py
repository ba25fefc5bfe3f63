"""A document quality classifier: multiple-instance learning with gated attention over passages.

A document is a bag of passages. Each passage is encoded from frequencies of byte classes and of
neighbouring classes, and from how far it compresses. A gated attention network, trained from the
documents' labels alone, weights the passages; the weighted representation gives the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PASSAGE = 1024          # bytes of a passage, more in long texts
PASSAGES = 64           # at most so many cover a text
GROUP_BYTES = 1 << 18   # text encoded together; scores do not depend on it
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",;:", b"!?",
         b"|", b"#$%&*@^~+=<>/\\_`", b"()[]{}", b"'\"", b"-"]
WIDTH = 16
KIND = np.full(256, WIDTH - 2, np.uint8)
KIND[0x80:0xC0] = WIDTH - 1
for _i, _members in enumerate(KINDS):
    KIND[list(_members)] = _i
FEATURES = WIDTH + WIDTH * WIDTH + 2


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text); an empty text has one passage of zeros."""
    features, counts = [], []
    group: list[bytes] = []

    def encode() -> None:
        sizes, pieces = [], []
        for raw in group:
            step = max(PASSAGE, -(-len(raw) // PASSAGES))
            own = [raw[i:i + step] for i in range(0, len(raw), step)] or [b""]
            counts.append(len(own))
            pieces += own
        sizes = np.array([len(p) for p in pieces])
        kind = KIND[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        single = np.bincount(owner * WIDTH + kind, minlength=len(pieces) * WIDTH).reshape(len(pieces), WIDTH)
        # Neighbours count inside a passage only, so that what stands beside a text has no part in its score.
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        double = np.bincount(owner[inside] * WIDTH ** 2 + kind[inside] * WIDTH + kind[inside + 1], minlength=len(pieces) * WIDTH ** 2).reshape(len(pieces), WIDTH ** 2)
        room = np.maximum(sizes, 1)[:, None]
        packed = np.array([len(zlib.compress(p, 1)) - 8 if p else 0 for p in pieces])[:, None] / room
        features.append(np.hstack([single / room, double / room, packed, np.log1p(sizes)[:, None] / 10]).astype(np.float32))
        group.clear()

    size = 0
    for text in texts:
        group.append((text or "").encode())
        size += len(group[-1])
        if size >= GROUP_BYTES:
            encode()
            size = 0
    if group:
        encode()
    return (np.concatenate(features) if features else np.zeros((0, FEATURES), np.float32)), np.array(counts, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(model: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray):
    """Score of each bag, and what the gradient needs."""
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    z = (x - model["mean"]) / model["scale"]
    h = np.tanh(z @ model["w"] + model["b"])
    t, s = np.tanh(h @ model["v"]), sigmoid(h @ model["u"])
    e = (t * s) @ model["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[owner])
    weight = e / np.add.reduceat(e, first)[owner]
    bag = np.add.reduceat(weight[:, None] * h, first)
    return sigmoid(bag @ model["c"] + model["d"]), (z, h, t, s, weight, bag, owner)


def train(x: np.ndarray, counts: np.ndarray, label: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 30, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights fitted with Adam on the log loss of the documents' labels (0 or 1)."""
    rng = np.random.default_rng(seed)
    model = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-2}
    learned = {"w": rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), "b": np.zeros(hidden),
               "v": rng.standard_normal((hidden, gate)) / np.sqrt(hidden), "u": rng.standard_normal((hidden, gate)) / np.sqrt(hidden),
               "a": rng.standard_normal(gate) / np.sqrt(gate), "c": rng.standard_normal(hidden) / np.sqrt(hidden), "d": np.zeros(1)}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in learned.items()}
    first, step = np.cumsum(counts) - counts, 0
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in docs])
            score, (z, h, t, s, weight, bag, owner) = forward(model | learned, x[rows], counts[docs])
            g = (score - label[docs]) / len(docs)
            by_bag = g[:, None] * learned["c"]
            by_weight = (by_bag[owner] * h).sum(axis=1)
            mean = np.add.reduceat(weight * by_weight, np.cumsum(counts[docs]) - counts[docs])[owner]
            by_e = weight * (by_weight - mean)
            by_gate = by_e[:, None] * learned["a"]
            by_t, by_s = by_gate * s * (1 - t * t), by_gate * t * s * (1 - s)
            by_h = weight[:, None] * by_bag[owner] + by_t @ learned["v"].T + by_s @ learned["u"].T
            by_z = by_h * (1 - h * h)
            gradient = {"w": z.T @ by_z, "b": by_z.sum(axis=0), "v": h.T @ by_t, "u": h.T @ by_s, "a": (t * s).T @ by_e, "c": bag.T @ g, "d": np.array([g.sum()])}
            step += 1
            for k, v in learned.items():
                d = gradient[k] + decay * v
                m, n = moment[k]
                m += 0.1 * (d - m)
                n += 0.001 * (d * d - n)
                v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(n / (1 - 0.999 ** step)) + 1e-8)
    return model | learned


def held_out(id: str | Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold kept from training; a null id counts as ''."""
    text = F.coalesce((F.col(id) if isinstance(id, str) else id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id: str = "doc_id", text: str = "text", sample: int = 4000) -> dict[str, np.ndarray] | float:
    """A model of P(label 1), or that probability itself where the training labels are all alike (0.5 without any).

    Trained on at most ``sample`` labelled documents outside the held-out fold, those with the
    smallest hash of their id; a document with several labels takes their rounded mean, an id with
    several texts the first of them. Null labels and ids teach nothing; null texts count as empty,
    long ones are read whole.
    """
    known = (labels.where(F.col(target).isNotNull() & F.col(id).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("doc"))
             .agg((F.avg(target) >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc"), "doc").limit(sample))
    picked = docs.select(F.col(id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(known), "doc").groupBy("doc", "label").agg(F.min("body").alias("body"))
    kind = docs.schema[id].dataType.simpleString()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, counts = passages(frame["body"].tolist())
            stop = np.cumsum(counts)
            yield pd.DataFrame({"doc": frame["doc"], "label": frame["label"], "n": counts, "x": [x[b - n:b].tobytes() for b, n in zip(stop, counts)]})

    bags = sorted(picked.mapInPandas(encode, f"doc {kind}, label int, n long, x binary").collect(), key=lambda r: (r.doc, r.x))
    label = np.array([r.label for r in bags], float)
    if not len(label) or label.min() == label.max():
        return float(label[0]) if len(label) else 0.5
    x = np.frombuffer(b"".join(r.x for r in bags), np.float32).reshape(-1, FEATURES)
    return train(x, np.array([r.n for r in bags]), label)


def scorer(docs: DataFrame, model: dict[str, np.ndarray] | float):
    """A column function: text -> score between 0 and 1. A null text counts as empty, a long one is read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            if isinstance(shared.value, float):
                yield pd.Series(np.full(len(texts), shared.value))
                continue
            out = []
            for at in range(0, len(texts), 500):
                x, counts = passages(texts.iloc[at:at + 500].tolist())
                out.append(forward(shared.value, x, counts)[0])
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, target: str = "quality", id: str = "doc_id", text: str = "text", sample: int = 4000) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Whole texts are read; a null or empty text has one empty passage. Only the text decides a
    score: equal texts score alike, repeated rows each get it. Rows with a null id are scored too. An empty table gives no
    rows. Other columns are left out.
    """
    score = scorer(docs, fit(docs, labels, target, id, text, sample))
    return (docs.select(F.col(id).alias(id), F.col(text).alias("body"))
            .select(id, held_out(id).alias("held_out"), score("body").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
