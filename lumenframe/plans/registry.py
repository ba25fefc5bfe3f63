"""Name -> (Spark query, SQL). SQL that checks a query is written from the definition."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Run = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}
# Moves values off rounding ties, which the two engines break differently.
NUDGE = 3e-7


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(c: Column | str, digits: int = 4) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value.cast("double") + NUDGE, digits)


def r(sql: str, digits: int = 4) -> str:
    """The SQL form of ``rounded``."""
    return f"round(cast({sql} as double) + {NUDGE}, {digits})"


def show(df: DataFrame, digits: int = 4, skip: tuple[str, ...] = ()) -> DataFrame:
    """Every double column rounded for comparison."""
    return df.select(*[
        rounded(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() == "double" and f.name not in skip
        else F.col(f"`{f.name}`") for f in df.schema.fields])
