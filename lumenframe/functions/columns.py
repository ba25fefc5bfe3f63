"""Null rules, number parsing and schema helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def require(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")


def to_number(c: Column) -> Column:
    """Double, with text that is no number and NaN both as null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def number(df: DataFrame, name: str) -> Column:
    """The column as a clean double; integer columns skip the NaN test."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return col(name).cast("double")
    return to_number(col(name))


def to_time(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text that is no date becomes null."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_timestamp(col(name))
    return col(name).cast("timestamp_ntz")


def is_missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, and -0.0 becomes 0.0, as grouping keys need."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(n)), col(n) + F.lit(0.0).cast(df.schema[n].dataType)).alias(n)
        if n in floats else col(n) for n in df.columns
    ])


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI mode would raise)."""
    return F.try_divide(a, b)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; null stays null although greatest/least skip nulls."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def safe_name(text: str) -> str:
    """Letters and digits kept, every other character an underscore."""
    return "".join(ch if ch.isalnum() else "_" for ch in str(text))
