"""Ranks and rank statistics from the table of distinct values.

Equal values are first folded into one row with their count (combined before the
shuffle), so a hot value costs one row; cumulative counts then run over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, normalise_missing
from lumenframe.operators.ordered import running
from lumenframe.session import ensure_checkpoint_dir

HOT_ROWS = 1_000_000


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), ascending: bool = True,
                ranges: int | None = None) -> DataFrame:
    """One row per distinct non-null value: n, rows before it, distinct values up to it.

    The folded table is read several times and so written to the checkpoint folder once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    counts = (normalise_missing(df).where(col(value).isNotNull())
              .groupBy(*[col(b) for b in by], col(value)).agg(F.count(F.lit(1)).alias("__n"))).checkpoint()
    out = running(counts, {"__upto": ("sum", "__n")}, [(value, ascending)], by,
                  row_number="__dense", ranges=ranges)
    return out.withColumn("__below", F.col("__upto") - F.col("__n"))


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str],
           n: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``table`` (unique keys) that no hot key can skew.

    Keys with more than ``hot_rows`` rows are broadcast: there are at most rows / hot_rows
    of them. Their rows get a spread value so that the shuffle join of the remaining keys
    does not bring them together; so do rows whose nulls stand in a set of keys that no row
    of ``table`` has null alike, since they have no partner. A null key that the table holds
    matches like any other. ``n`` names the column of ``table`` that holds the row counts;
    without it they are counted first.
    """
    df = normalise_missing(df)
    if n is None:
        heat = df.groupBy(*[col(k).alias(f"__heat_{i}") for i, k in enumerate(keys)]).agg(
            F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
        hit = F.lit(True)
        for i, k in enumerate(keys):
            hit = hit & col(k).eqNullSafe(F.col(f"__heat_{i}"))
        table = table.join(F.broadcast(heat), hit, "left").fillna(0, ["__n"])
        n = "__n"

    def renamed(t: DataFrame, tag: str) -> DataFrame:
        return t.select(*[col(k).alias(f"__{tag}_k{i}") for i, k in enumerate(keys)],
                        *[col(v).alias(f"__{tag}_{v}") for v in values], F.lit(True).alias(f"__{tag}"))

    def same(tag: str) -> Column:
        out = F.lit(True)
        for i, k in enumerate(keys):
            out = out & col(k).eqNullSafe(F.col(f"__{tag}_k{i}"))
        return out

    hot = renamed(table.where(col(n) > hot_rows), "hot")
    cold = renamed(table.where(col(n) <= hot_rows), "cold").withColumn("__zero", F.lit(0))
    nulls = F.concat(*[F.when(col(k).isNull(), "1").otherwise("0") for k in keys])
    # At most 2 ** len(keys) rows: which keys are null together in the table.
    patterns = table.select(nulls.alias("__nulls"), F.lit(True).alias("__paired")).distinct()
    marked = df.withColumn("__nulls", nulls).join(F.broadcast(hot), same("hot"), "left").join(F.broadcast(patterns), "__nulls", "left")
    spread = F.when(F.col("__hot") | F.col("__paired").isNull(), F.spark_partition_id() + 1).otherwise(F.lit(0))
    marked = marked.withColumn("__spread", spread)
    out = marked.join(cold, same("cold") & (F.col("__spread") == F.col("__zero")), "left")
    return out.select(*[col(c) for c in df.columns],
                      *[F.coalesce(F.col(f"__hot_{v}"), F.col(f"__cold_{v}")).alias(v) for v in values])


def rank(df: DataFrame, column: str, method: str = "dense", ascending: bool = False,
         by: Sequence[str] = (), name: str | None = None, tie_break: str | None = None,
         ranges: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank of a column; methods dense, min, max, average (cut to whole numbers), first, percent.

    Null values get a null rank. ``first`` numbers ties by ``tie_break``, a unique column.
    """
    out = name or f"{column}_rank"
    if method == "first":
        if not tie_break:
            raise ValueError("method first needs tie_break")
        numbered = running(df, {}, [(column, ascending), tie_break], by, row_number=out, ranges=ranges)
        return numbered.withColumn(out, F.when(col(column).isNotNull(), col(out)))
    table = value_ranks(df, column, by, ascending, ranges)
    first = F.col("__below") + 1
    if method == "percent":
        totals = table.groupBy(*[col(b) for b in by]).agg(F.max("__upto").alias("__all"))
        table = _with_totals(table, totals, by)
        value = F.when(F.col("__all") > 1, F.col("__below") / (F.col("__all") - 1)).otherwise(F.lit(0.0))
    else:
        forms = {"dense": F.col("__dense"), "min": first, "max": F.col("__upto"),
                 "average": F.floor((first + F.col("__upto")) / 2).cast("long")}
        if method not in forms:
            raise ValueError(f"unknown rank method: {method}")
        value = forms[method]
    return lookup(df, table.withColumn(out, value), [*by, column], [out], "__n", hot_rows)


def _with_totals(table: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """The group's total on each of its rows; a group with very many values is no hot spot."""
    return lookup(table, totals, by, ["__all"]) if by else table.withColumn("__all", totals.scalar())


def average_rank() -> Column:
    """Mean rank of a value in a ``value_ranks`` table."""
    return F.col("__below") + (F.col("__n") + 1) / 2


def ecdf(df: DataFrame, column: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Each distinct value with the share of rows at or below it, per group if given."""
    table = value_ranks(df.dropna(subset=list(by)) if by else df, column, by, True, ranges)
    totals = table.groupBy(*[col(b) for b in by]).agg(F.max("__upto").alias("__all"))
    joined = _with_totals(table, totals, by)
    return joined.select(*[col(b) for b in by], col(column), F.col("__n").alias("n"),
                         (F.col("__upto") / F.col("__all")).alias("ecdf"))
