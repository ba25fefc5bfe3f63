"""Main text of web pages: flat text blocks, classified by a decision tree on shallow features.

A block is described by the word count and link density of itself and its neighbours, by where the
page says it stands, and by whether that is a menu, header, footer, sidebar, notice, advert, form or
a reader's comment. The tree is trained on the small table LABELLED; it is a function of that table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumenframe.llm.html_blocks import Block, blocks

DEPTH = 6
SOME = 1 << 22          # characters of pages taken apart at once

# Pages as rows of (where, words, words in links, part of the main text), in the order of the page.
# Where: in the article; in the body of a page without one; beside the article of a page; in a marked aside of the body, in the article or beside it.
LABELLED: list[list[tuple[str, int, int, bool]]] = [
    [("away", 1, 1, False), ("away", 1, 1, False), ("away", 2, 2, False), ("away", 9, 0, False), ("article", 11, 0, True), ("article", 75, 0, True),
     ("article", 8, 0, True), ("article", 1, 0, True), ("article", 123, 6, True), ("inset", 14, 0, False), ("article", 40, 2, True), ("away", 11, 1, False)],
    [("beside", 3, 0, False), ("beside", 24, 3, False), ("article", 7, 0, True), ("article", 5, 5, True), ("article", 2, 0, True), ("article", 210, 14, True),
     ("article", 6, 6, True), ("article", 8, 8, True), ("article", 33, 9, True), ("beside", 60, 0, False), ("beside", 4, 4, False), ("away", 80, 0, False)],
    [("away", 30, 0, False), ("article", 1, 0, True), ("article", 1, 1, True), ("article", 3, 1, True), ("inset", 45, 0, False), ("inset", 120, 20, False),
     ("inset", 3, 3, False), ("article", 19, 19, True), ("beside", 90, 0, False), ("beside", 47, 11, False), ("away", 66, 12, False), ("away", 150, 40, False)],
    [("inset", 2, 2, False), ("inset", 8, 4, False), ("article", 16, 0, True), ("article", 44, 12, True), ("article", 51, 30, True), ("inset", 36, 36, False),
     ("inset", 1, 0, False), ("article", 10, 0, True), ("away", 5, 0, False), ("away", 190, 3, False), ("away", 7, 0, False), ("away", 95, 0, False)],
    [("body", 1, 1, False), ("body", 2, 2, False), ("body", 1, 1, False), ("body", 3, 3, False), ("body", 9, 0, True), ("body", 64, 2, True), ("body", 5, 0, True),
     ("body", 88, 0, True), ("body", 41, 9, True), ("body", 52, 0, True), ("body", 8, 8, False), ("body", 10, 10, False), ("body", 7, 7, False), ("body", 6, 2, False)],
    [("body", 4, 4, False), ("body", 5, 5, False), ("body", 6, 0, True), ("body", 35, 0, True), ("body", 28, 1, True), ("body", 12, 0, True), ("body", 31, 0, True),
     ("body", 3, 3, False), ("body", 2, 2, False), ("body", 4, 2, False), ("aside", 70, 0, False), ("aside", 48, 12, False), ("aside", 140, 30, False)],
    [("aside", 6, 0, False), ("body", 2, 2, False), ("body", 3, 3, False), ("body", 5, 4, False), ("body", 8, 0, True), ("body", 130, 5, True), ("body", 22, 0, True),
     ("body", 17, 1, True), ("body", 95, 3, True), ("aside", 16, 3, False), ("body", 1, 1, False), ("body", 1, 1, False), ("body", 9, 5, False)],
    [("body", 250, 0, True)], [("body", 1, 1, False), ("body", 1, 1, False), ("body", 40, 0, True)], [("body", 20, 20, False), ("body", 15, 14, False)],
    [("body", 6, 0, True), ("body", 1, 0, True), ("body", 48, 0, True), ("aside", 2, 0, False), ("aside", 25, 0, False), ("aside", 9, 0, False)],
    [("aside", 12, 0, False), ("aside", 200, 0, False), ("aside", 33, 0, False), ("body", 70, 6, True), ("aside", 1, 0, False), ("aside", 4, 0, False)],
]
WHERE = {"article": (1, False), "body": (0, False), "beside": (-1, False), "aside": (0, True), "inset": (1, True), "away": (-1, True)}


class Node(NamedTuple):
    """A test ``feature <= cut``, or a leaf's answer."""

    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    keep: bool = False


def features(words: Sequence[int], linked: Sequence[int], where: Sequence[int], aside: Sequence[bool]) -> np.ndarray:
    """(blocks, 8): words and link density of the block before, the block and the block after; place; whether aside."""
    n = np.asarray(words, np.float64)
    density = np.asarray(linked, np.float64) / np.maximum(n, 1)
    shallow = np.stack([n, density], axis=1)
    none = np.zeros((1, 2))
    return np.concatenate([np.concatenate([none, shallow[:-1]]), shallow, np.concatenate([shallow[1:], none]),
                           np.asarray(where, np.float64)[:, None], np.asarray(aside, np.float64)[:, None]], axis=1)


def gini(kept: np.ndarray, n: np.ndarray) -> np.ndarray:
    share = kept / n
    return 2 * share * (1 - share) * n


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Node:
    """A decision tree of least Gini impurity; equal splits go to the first feature and the lowest cut."""
    if depth == 0 or y.all() or not y.any():
        return Node(keep=bool(2 * y.sum() >= len(y)))
    best, found = gini(np.float64(y.sum()), np.float64(len(y))) - 1e-9, None
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        value, kept = x[order, feature], np.cumsum(y[order])
        ends = np.flatnonzero(value[1:] > value[:-1])
        if not len(ends):
            continue
        n = ends + 1
        cost = gini(kept[ends], n) + gini(kept[-1] - kept[ends], len(y) - n)
        at = cost.argmin()
        if cost[at] < best - 1e-9:
            best, found = cost[at], (feature, (value[ends[at]] + value[ends[at] + 1]) / 2)
    if found is None:
        return Node(keep=bool(2 * y.sum() >= len(y)))
    low = x[:, found[0]] <= found[1]
    return Node(*found, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree: Node, x: np.ndarray) -> np.ndarray:
    """Whether each block belongs to the main text."""
    if tree.low is None:
        return np.full(len(x), tree.keep)
    low, out = x[:, tree.feature] <= tree.cut, np.empty(len(x), bool)
    out[low], out[~low] = decide(tree.low, x[low]), decide(tree.high, x[~low])
    return out


def trained(labelled: list[list[tuple[str, int, int, bool]]] = LABELLED) -> Node:
    """The tree of a labelled table."""
    x = [features([b[1] for b in page], [b[2] for b in page], *zip(*[WHERE[b[0]] for b in page])) for page in labelled]
    return grow(np.concatenate(x), np.array([b[3] for page in labelled for b in page]))


def page_features(page: list[Block]) -> np.ndarray:
    """The features of a page's blocks. The article counts as the body's main part if it has half of the main part's words or more."""
    main = [b.words if b.inside and not b.aside else 0 for b in page]
    article = sum(b.words for b in page if b.inside == 2 and not b.aside)
    level = 2 if article and 2 * article >= sum(main) else 1
    there = any(main)
    return features([b.words for b in page], [b.linked for b in page], [(1 if b.inside >= level else -1) if there else 0 for b in page], [b.aside for b in page])


def main_blocks(html: str, tree: Node) -> list[str]:
    """The texts of a page's main blocks, in order."""
    page = blocks(html)
    return [b.text for b, keep in zip(page, decide(tree, page_features(page))) if keep] if page else []


def main_text(table: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row: the main text of its page, a line for each block.

    Character references are decoded and white space (Unicode's, no-break spaces too) inside a block
    is one space. A null or empty page, and one without main text, gives "". Long pages are read
    whole. Null ids and urls stay; repeated rows give a row each; nothing is ranked, so there are no
    ties. Other columns are left out; an empty table gives no rows.
    """
    tree = trained()

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size = frame["html"].str.len().cumsum() // SOME
            for _, some in frame.groupby(size.fillna(0).to_numpy(), sort=False):
                texts = ["\n".join(main_blocks(page, tree)) for page in some["html"]]
                yield pd.DataFrame({"id": some["id"], "url": some["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    rows = table.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    out = rows.mapInPandas(extract, f"id {kinds[id]}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text", "n_chars")
