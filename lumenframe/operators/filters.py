"""Row filters as predicates Catalyst can push to the scan."""

from __future__ import annotations

import functools
import operator as op
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, is_missing, is_numeric, number, numeric_columns, require
from lumenframe.operators.projection import COMPARE


def predicate(df: DataFrame, column: str, operator: str, value=None) -> Column:
    """One condition. Only ``!=`` and ``isnull`` keep null rows."""
    require(df, [column])
    c = col(column)
    if operator == "isnull":
        return is_missing(df, column)
    if operator == "notnull":
        return ~is_missing(df, column)
    if operator == "isin":
        values = [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)
        kind = df.schema[column].dataType
        return c.isin([F.lit(v).cast(kind) for v in values])
    if operator == "contains":
        return c.cast("string").rlike("(?i)" + str(value))
    if operator == "startswith":
        return c.cast("string").startswith(str(value))
    if operator == "endswith":
        return c.cast("string").endswith(str(value))
    if operator not in COMPARE:
        raise ValueError(f"unknown operator: {operator}")
    if is_numeric(df, column):
        return COMPARE[operator](c, F.lit(float(value)))
    if operator in ("==", "!="):
        return COMPARE[operator](c.cast("string"), F.lit(str(value)))
    raise ValueError(f"{operator} needs a numeric column, {column} is not")


def filter_rows(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    return df.where(predicate(df, column, operator, value))


def multi_filter(df: DataFrame, conditions: Sequence[Mapping], logic: str = "AND") -> DataFrame:
    """Conditions {column, operator, value} under AND or OR; unknown columns are skipped."""
    known = [predicate(df, c["column"], c["operator"], c.get("value"))
             for c in conditions if c["column"] in df.columns]
    if not known:
        return df
    return df.where(functools.reduce(op.and_ if logic.upper() == "AND" else op.or_, known))


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column holds the pattern, in any case."""
    hits = [F.coalesce(col(c).cast("string").rlike("(?i)" + text), F.lit(False)) for c in df.columns]
    return df.where(functools.reduce(op.or_, hits))


def above_mean(df: DataFrame, column: str) -> DataFrame:
    """Rows above the column's mean; the mean is a scalar subquery, not a shuffle of the rows."""
    value = number(df, column)
    return df.where(value > df.agg(F.avg(value)).scalar())


def in_geo_range(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.where(number(df, lat).between(-90, 90) & number(df, lon).between(-180, 180))


def value_share(df: DataFrame, column: str, value) -> DataFrame:
    """One row: rows equal to the value, their percentage, the rest."""
    hit = F.count_if(col(column).eqNullSafe(F.lit(value)))
    total = F.count(F.lit(1))
    return df.agg(hit.alias("matching"), F.try_divide(hit * 100.0, total).alias("pct"),
                  (total - hit).alias("remaining"))


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def first_numeric(df: DataFrame) -> str:
    names = numeric_columns(df)
    if not names:
        raise ValueError("the table has no numeric column")
    return names[0]
