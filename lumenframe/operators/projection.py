"""Columns: keep, rename, drop, derive, split, combine, convert."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, is_numeric, is_text, require, to_number


def select_rename_drop(df: DataFrame, keep: Sequence[str] = (), rename: Mapping[str, str] | None = None,
                       drop: Sequence[str] = ()) -> DataFrame:
    """Drop, then keep, then rename; names the table does not have are ignored."""
    out = df.drop(*[c for c in drop if c in df.columns])
    kept = [c for c in keep if c in out.columns]
    if kept:
        out = out.select(*[col(c) for c in kept])
    return out.withColumnsRenamed({k: v for k, v in (rename or {}).items() if k in out.columns})


def calculated_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A column from a SQL expression over the table's columns."""
    return df.withColumn(name, F.expr(expression))


COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: ~a.eqNullSafe(b), ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def conditional_column(df: DataFrame, name: str, column: str, operator: str, value, then, otherwise) -> DataFrame:
    """``then`` where the comparison holds, else ``otherwise`` (also for null)."""
    if operator not in COMPARE:
        raise ValueError(f"unknown comparison: {operator}")
    left, right = col(column), F.lit(value)
    if is_text(df, column):
        if operator in ("==", "!="):
            right = F.lit(str(value))
        else:
            left, right = to_number(left), F.lit(float(value))
    return df.withColumn(name, F.when(COMPARE[operator](left, right), F.lit(then)).otherwise(F.lit(otherwise)))


def combine_columns(df: DataFrame, columns: Sequence[str], sep: str = " ", name: str = "combined") -> DataFrame:
    """Columns joined as text; null counts as empty text."""
    require(df, columns)
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]
    return df.withColumn(name, F.concat_ws(sep, *parts))


def split_column(df: DataFrame, column: str, sep: str, parts: int | None = None) -> DataFrame:
    """``<column>_part_1..n``; n is the largest number of parts (one aggregate) unless given."""
    require(df, [column])
    pieces = F.split(col(column).cast("string"), _literal_regex(sep))
    if parts is None:
        parts = df.agg(F.max(F.size(pieces))).first()[0] or 1
    return df.select("*", *[F.try_element_at(pieces, F.lit(i + 1)).alias(f"{column}_part_{i + 1}")
                            for i in range(parts)])


def _literal_regex(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def constant_column(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def copy_column(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, col(column))


def convert_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """datetime | numeric | categorical | string | bool; values that do not convert become null."""
    def converted(name: str, kind: str) -> Column:
        c = col(name)
        if kind == "datetime":
            return F.try_to_timestamp(c) if is_text(df, name) else c.try_cast("timestamp")
        if kind == "numeric":
            return to_number(c)
        if kind in ("categorical", "string"):
            return c.cast("string")
        if kind == "bool":
            truth = (c != 0) if is_numeric(df, name) else (c.cast("string") != "")
            return F.when(c.isNotNull(), truth)
        raise ValueError(f"unknown type: {kind}")

    require(df, types)
    return df.select(*[converted(c, types[c]).alias(c) if c in types else col(c) for c in df.columns])
