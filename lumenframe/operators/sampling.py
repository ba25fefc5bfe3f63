"""Sort, top-k and samples that are the same on every run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, number, require
from lumenframe.operators.ordered import SortKey, sort_columns, sort_keys

_PARTS = 1_000_000


def sort(df: DataFrame, keys: Sequence[Mapping]) -> DataFrame:
    """Keys {column, ascending}; nulls last in both directions, unknown columns ignored."""
    known = [SortKey(k["column"], k.get("ascending", True)) for k in keys if k["column"] in df.columns]
    return df.orderBy(*sort_columns(known)) if known else df


def head(df: DataFrame, n: int, order_by) -> DataFrame:
    return df.orderBy(*sort_columns(sort_keys(order_by))).limit(n)


def tail(df: DataFrame, n: int, order_by) -> DataFrame:
    """The last n rows of the order, found as the first n of the reverse."""
    keys = sort_keys(order_by)
    reverse = [col(k.name).desc_nulls_first() if k.ascending else col(k.name).asc_nulls_first() for k in keys]
    return df.orderBy(*reverse).limit(n).orderBy(*sort_columns(keys))


def top_n(df: DataFrame, metric: str, n: int, tie_break: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    value = number(df, metric)
    order = value.asc() if ascending else value.desc()
    return df.where(value.isNotNull()).orderBy(order, *[col(t) for t in tie_break]).limit(n)


def _hash(key: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*[col(k) for k in key], F.lit(seed))


def sample_fraction(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """About this share of the rows, chosen by a hash of the key: no shuffle, same rows every time."""
    require(df, key)
    return df.where(F.pmod(_hash(key, seed), F.lit(_PARTS)) < F.lit(int(fraction * _PARTS)))


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (or all): the n smallest hashes, a top-k rather than a sort."""
    require(df, key)
    return df.orderBy(_hash(key, seed), *[col(k) for k in key]).limit(n)


def sample_stratified(df: DataFrame, column: str, fractions: Mapping, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A share per value of the column; values not named are left out."""
    require(df, [column, *key])
    share = F.lit(0)
    for value, fraction in fractions.items():
        share = F.when(col(column) == F.lit(value), F.lit(int(fraction * _PARTS))).otherwise(share)
    return df.where(F.pmod(_hash(key, seed), F.lit(_PARTS)) < share)


def preview(df: DataFrame, page: int = 1, page_size: int = 50, sort_by: str | None = None,
            ascending: bool = True, key: Sequence[str] = ()) -> DataFrame:
    """One page of the table, sorted by ``sort_by`` and then the key."""
    order = ([(sort_by, ascending)] if sort_by else []) + list(key)
    if not order:
        raise ValueError("a page needs sort_by or key")
    return df.orderBy(*sort_columns(sort_keys(order))).offset((page - 1) * page_size).limit(page_size)
