"""Association rules over baskets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from lumenframe.functions.columns import col, safe_div
from lumenframe.session import ensure_checkpoint_dir

# A task of the pair count holds one square matrix over the frequent items.
MATRIX_ITEMS = 2_000


def _frequent(df: DataFrame, transaction: str, item: str, min_support: float) -> tuple[DataFrame, int, dict[str, int]]:
    """Distinct (transaction, item) rows of frequent items, number of transactions, item counts.

    At most (mean basket size / min_support) items are frequent, whatever the size of the table. The rows are
    written once, as they are counted before they are used.
    """
    ensure_checkpoint_dir(df.sparkSession)
    pairs = df.dropna(subset=[transaction, item]).select(
        col(transaction).alias("t"), col(item).cast("string").alias("i")).distinct().checkpoint()
    total = pairs.agg(F.count_distinct("t")).first()[0]
    items = {r["i"]: r["n"] for r in pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= min_support * total).collect()}
    return pairs.where(F.col("i").isin(list(items))), total, items


RULES = "antecedent string, consequent string, support double, confidence double, lift double"


def pair_rules(df: DataFrame, transaction: str, item: str, min_support: float = 0.05, min_confidence: float = 0.2,
               min_lift: float = 1.0, top: int | None = None) -> DataFrame:
    """Rules between two items, exact.

    Co-occurrences are summed as matrix products inside the tasks, so no pair is emitted per
    basket: a task returns one count per pair of frequent items.
    """
    pairs, total, counts = _frequent(df, transaction, item, min_support)
    spark = df.sparkSession
    if total < 2:
        raise ValueError("at least two transactions are needed")
    names = sorted(counts)
    if len(names) > MATRIX_ITEMS:
        raise ValueError(f"{len(names)} frequent items: raise min_support or use association_rules")
    if not names:
        return spark.createDataFrame([], RULES)
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    # Baskets hold frequent items only, once each: their size is bounded by the number of those items.
    baskets = pairs.groupBy("t").agg(F.collect_list(number[F.col("i")]).alias("items")).select("items")

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(names), len(names)))
        for batch in batches:
            for start in range(0, len(batch), 5_000):
                lists = batch["items"].iloc[start:start + 5_000]
                hot = np.zeros((len(lists), len(names)), dtype=np.float32)
                rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                hot[rows, np.concatenate([np.asarray(x, dtype=int) for x in lists])] = 1
                sums += hot.T @ hot
        a, b = np.nonzero(np.triu(sums, 1))
        yield pd.DataFrame({"a": a, "b": b, "n": sums[a, b].astype("int64")})

    both = baskets.mapInPandas(together, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = both.where(F.col("n") >= min_support * total)
    label = F.array(*[F.lit(n) for n in names])
    size = F.array(*[F.lit(counts[n]) for n in names])
    ways = both.select("n", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                              F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("w"))
    nx, ny = F.element_at(size, F.col("w.x") + 1), F.element_at(size, F.col("w.y") + 1)
    rules = ways.select(F.element_at(label, F.col("w.x") + 1).alias("antecedent"), F.element_at(label, F.col("w.y") + 1).alias("consequent"),
                        (F.col("n") / F.lit(total)).alias("support"), (F.col("n") / nx).alias("confidence"),
                        safe_div(F.col("n") / nx, ny / F.lit(total)).alias("lift"))
    kept = rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)).orderBy(
        F.desc("lift"), "antecedent", "consequent")
    return kept.limit(top) if top else kept


def _mined(df: DataFrame, transaction: str, item: str, min_support: float, min_confidence: float):
    pairs, total, _ = _frequent(df, transaction, item, min_support)
    if total < 2:
        raise ValueError("at least two transactions are needed")
    # Written once: they are counted, and read again by each step of the mining.
    baskets = pairs.groupBy("t").agg(F.collect_list("i").alias("items")).select("items").checkpoint()
    # Support is relative to the baskets MLlib sees; baskets without a frequent item are not among them.
    seen = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * total / max(seen, 1)),
                     minConfidence=min_confidence).fit(baskets)
    return model, total, seen


def frequent_itemsets(df: DataFrame, transaction: str, item: str, min_support: float = 0.05) -> DataFrame:
    """Sets of items with their support."""
    model, total, _ = _mined(df, transaction, item, min_support, 0.5)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), (F.col("freq") / F.lit(total)).alias("support"))


def association_rules(df: DataFrame, transaction: str, item: str, min_support: float = 0.05, min_confidence: float = 0.2,
                      min_lift: float = 1.0, top: int | None = None) -> DataFrame:
    """Rules of any length from FP-growth, with conviction, by falling lift."""
    model, total, seen = _mined(df, transaction, item, min_support, min_confidence)
    share = F.lit(seen / total)
    rules = model.associationRules.select(
        F.array_join(F.array_sort("antecedent"), ", ").alias("antecedent"), F.array_join(F.array_sort("consequent"), ", ").alias("consequent"),
        (F.col("support") * share).alias("support"), "confidence", (F.col("lift") / share).alias("lift"))
    consequent = safe_div(F.col("confidence"), F.col("lift"))
    rules = rules.withColumn("conviction", safe_div(1 - consequent, 1 - F.col("confidence")))
    kept = rules.where(F.col("lift") >= min_lift).orderBy(F.desc("lift"), "antecedent", "consequent")
    return kept.limit(top) if top else kept
