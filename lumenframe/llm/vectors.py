"""Vectors as bytes, and folding equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str) -> Column:
    """Whether a vector is not null, holds only finite numbers and is not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rows_of(table: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec, v, key) of the rows that take part: components as doubles, -0.0 as 0.0, key a 128-bit hash."""
    rows = table.select(F.col(id).cast("long").alias("vec"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec").isNotNull() & usable("v"))
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.md5(F.concat_ws(",", F.col("v").cast("array<string>"))))
