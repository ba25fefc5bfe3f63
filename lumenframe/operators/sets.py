"""Union, concatenation, distinct, unpivot."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lumenframe.functions.columns import col


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """By name; columns one side lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def concat(tables: Sequence[DataFrame], columns: str = "outer") -> DataFrame:
    """All tables below each other: every column (outer) or the common ones (inner)."""
    if columns == "inner":
        common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
        tables = [t.select(*[col(c) for c in common]) for t in tables]
    return functools.reduce(union_all, tables)


def dedup(df: DataFrame, keep: str = "first") -> DataFrame:
    """Full-row duplicates; first and last give the same rows, drop_all leaves unrepeated rows only."""
    if keep in ("first", "last"):
        return df.distinct()
    if keep != "drop_all":
        raise ValueError(f"unknown keep: {keep}")
    counted = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return counted.where("__copies = 1").drop("__copies")


def unpivot(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None,
            var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Long form; values of different types become text, nulls are kept."""
    values = list(value_vars) if value_vars else [c for c in df.columns if c not in id_vars]
    kinds = {df.schema[c].dataType.simpleString() for c in values}
    if len(kinds) > 1:
        numeric = kinds <= {"int", "bigint", "double", "float", "smallint", "tinyint"}
        df = df.withColumns({c: col(c).cast("double" if numeric else "string") for c in values})
    return df.unpivot([col(c) for c in id_vars], [col(c) for c in values], var_name, value_name)
