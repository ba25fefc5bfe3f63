"""Clustering, principal components, elbow curve and segmentation use cases."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from lumenframe.functions.columns import col, number, numeric_columns, string_columns
from lumenframe.operators.baskets import association_rules
from lumenframe.operators.dbscan import dbscan
from lumenframe.operators.minibatch import minibatch_kmeans
from lumenframe.operators.ward import ward

SCALED = "scaled"


def scaled_vectors(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows complete in the columns, with a vector centred and divided by the population deviation."""
    names = [c for c in columns if c in numeric_columns(df)]
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed")
    rows = df.dropna(subset=names)
    stats = rows.agg(*[x for c in names for x in (F.avg(number(rows, c)), F.stddev_pop(number(rows, c)))]).first()
    z = {f"__z{i}": (number(rows, c) - F.lit(stats[2 * i])) / F.lit(stats[2 * i + 1] or 1.0) for i, c in enumerate(names)}
    packed = VectorAssembler(inputCols=list(z), outputCol=SCALED).transform(rows.withColumns(z))
    return packed.drop(*z), names


class Clusters(NamedTuple):
    rows: DataFrame
    sizes: DataFrame
    silhouette: float | None
    explained_pct: float


def cluster(df: DataFrame, columns: Sequence[str], k: int = 3, algorithm: str = "kmeans", eps: float = 0.8,
            min_samples: int = 5, key: str | None = None, seed: int = 42) -> Clusters:
    """Cluster per row with two principal coordinates, sizes and silhouette.

    kmeans is Spark's k-means, bisecting its top-down form, gmm a Gaussian mixture.
    minibatch_kmeans moves centres by hash-drawn batches (rows with equal columns are drawn together
    without ``key``); hierarchical is Ward's criterion on clustering features; dbscan needs a
    unique ``key`` column. The silhouette uses squared distances.
    """
    rows, names = scaled_vectors(df, columns)
    if algorithm == "dbscan":
        if key is None:
            raise ValueError("dbscan needs key")
        z = rows.withColumn("__v", vector_to_array(SCALED))
        points = z.select(col(key), *[F.col("__v")[i].alias(f"z{i}") for i in range(len(names))])
        labels = dbscan(points, key, [f"z{i}" for i in range(len(names))], eps, min_samples)
        labelled = rows.join(labels.withColumnRenamed(key, "__key"), col(key) == F.col("__key")).drop("__key")
    elif algorithm in ("hierarchical", "minibatch_kmeans"):
        z = rows.withColumn("__v", vector_to_array(SCALED))
        places = [f"__z{i}" for i in range(len(names))]
        z = z.withColumns({p: F.col("__v")[i] for i, p in enumerate(places)})
        labelled = (ward(z, places, k) if algorithm == "hierarchical"
                    else minibatch_kmeans(z, [key] if key else names, places, k, seed=seed).drop("distance")).drop("__v", *places)
    else:
        learners = {
            "kmeans": lambda: KMeans(k=k, seed=seed, initSteps=5, featuresCol=SCALED, predictionCol="cluster"),
            "bisecting": lambda: BisectingKMeans(k=k, seed=seed, featuresCol="__moved", predictionCol="cluster"),
            "gmm": lambda: GaussianMixture(k=k, seed=seed, featuresCol=SCALED, predictionCol="cluster"),
        }
        if algorithm not in learners:
            raise ValueError(f"unknown algorithm: {algorithm}")
        # Bisecting k-means splits by noise in proportion to the centre, which must not be the origin.
        moved = array_to_vector(F.transform(vector_to_array(SCALED), lambda v: v + 10.0))
        ready = rows.withColumn("__moved", moved) if algorithm == "bisecting" else rows
        labelled = learners[algorithm]().fit(ready).transform(ready).drop("probability", "__moved")
    pca = PCA(k=2, inputCol=SCALED, outputCol="__pc").fit(rows)
    out = pca.transform(labelled).withColumn("__pc", vector_to_array("__pc"))
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    found = [r["cluster"] for r in sizes.where("cluster >= 0").limit(2).collect()]
    silhouette = None
    if len(found) >= 2:
        kept = labelled.where("cluster >= 0").withColumn("cluster", F.col("cluster").cast("double"))
        silhouette = ClusteringEvaluator(featuresCol=SCALED, predictionCol="cluster").evaluate(kept)
    return Clusters(out.select(*[col(c) for c in df.columns], "cluster", F.col("__pc")[0].alias("pca_1"), F.col("__pc")[1].alias("pca_2")),
                    sizes, silhouette, 100 * float(sum(pca.explainedVariance)))


def elbow(df: DataFrame, columns: Sequence[str], max_k: int = 8, seed: int = 42) -> DataFrame:
    """Inertia for k = 1 to ``max_k``; k = 1 is the total spread."""
    rows, names = scaled_vectors(df, columns)
    n = rows.count()
    out = [(1, float(n * len(names)))]
    for k in range(2, min(max_k, n - 1) + 1):
        out.append((k, float(KMeans(k=k, seed=seed, featuresCol=SCALED).fit(rows).summary.trainingCost)))
    return df.sparkSession.createDataFrame(out, "k int, inertia double")


def principal_components(df: DataFrame, columns: Sequence[str], n: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows with ``pc_1..n``, and the percent of spread each component explains."""
    rows, names = scaled_vectors(df, columns)
    n = min(n, len(names))
    model = PCA(k=n, inputCol=SCALED, outputCol="__pc").fit(rows)
    out = model.transform(rows).withColumn("__pc", vector_to_array("__pc"))
    explained = [(i + 1, 100 * float(v)) for i, v in enumerate(model.explainedVariance)]
    return (out.select(*[col(c) for c in df.columns], *[F.col("__pc")[i].alias(f"pc_{i + 1}") for i in range(n)]),
            df.sparkSession.createDataFrame(explained, "component int, explained_pct double"))


# Name parts of the columns each use case looks for.
CUSTOMER_WORDS = ["tenure", "charge", "spend", "recency", "frequency", "monetary", "price", "age", "order", "income"]
PRODUCT_WORDS = ["price", "cost", "quantity", "margin", "profit", "rating", "volume", "sales", "discount"]


def _chosen(df: DataFrame, words: Sequence[str], fallback: int) -> list[str]:
    numbers = numeric_columns(df)
    if len(numbers) < 2:
        raise ValueError("at least two numeric columns are needed")
    named = [c for c in numbers if any(w in c.lower() for w in words)]
    return named if len(named) >= 2 else numbers[:fallback]


def customer_segments(df: DataFrame) -> Clusters:
    return cluster(df, _chosen(df, CUSTOMER_WORDS, 4), 4, "kmeans")


def product_groups(df: DataFrame) -> Clusters:
    return cluster(df, _chosen(df, PRODUCT_WORDS, 3), 3, "hierarchical")


def behaviour_segments(df: DataFrame, key: str) -> Clusters:
    columns = [c for c in numeric_columns(df) if c != key][:4]
    return cluster(df, columns, algorithm="dbscan", eps=1.0, min_samples=4, key=key)


def market_basket(df: DataFrame, top: int | None = None) -> DataFrame:
    """Rules between the first two text columns: transaction, then item; all of them unless ``top`` is given."""
    texts = string_columns(df)
    if len(texts) < 2:
        raise ValueError("two text columns are needed: transaction and item")
    return association_rules(df, texts[0], texts[1], min_support=0.05, min_confidence=0.1, top=top)
