"""Exports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from lumenframe.operators.ordered import sort_columns, sort_keys


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The whole table, one file per task, each with a header."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_records(df: DataFrame, path: str, n: int | None = None, order_by=None, mode: str = "errorifexists") -> None:
    """All records, or the first ``n`` in the given order."""
    out = df.orderBy(*sort_columns(sort_keys(order_by))) if order_by else df
    (out.limit(n) if n else out).write.mode(mode).json(path)


def batches(df: DataFrame, size: int = 5000) -> Iterator[list[Row]]:
    """Rows in lists of ``size``; one partition at a time is held by the caller."""
    held: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
