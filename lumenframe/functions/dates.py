"""Date functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import to_time

# Strftime letters and the Spark datetime pattern that prints the same.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%p": "a", "%A": "EEEE", "%a": "EEE",
    "%B": "MMMM", "%b": "MMM", "%%": "%",
}


def spark_pattern(strftime: str) -> str:
    """A strftime format as a Spark datetime pattern; other letters are quoted."""
    out, i = [], 0
    while i < len(strftime):
        pair = strftime[i:i + 2]
        if pair in STRFTIME:
            out.append(STRFTIME[pair])
            i += 2
            continue
        ch = strftime[i]
        if ch == "%":
            raise ValueError(f"unsupported date format letter: {pair}")
        out.append(f"'{ch}'" if ch.isalpha() else ("''" if ch == "'" else ch))
        i += 1
    return "".join(out)


def is_weekend(c: Column) -> Column:
    return F.weekday(c) >= 5


def season(c: Column) -> Column:
    """Northern season of the month; null for a null date."""
    m = F.month(c)
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
            .when(m.isin(6, 7, 8), "Summer").when(m.isNotNull(), "Fall"))


def days_until(c: Column, as_of: Column) -> Column:
    """Whole days from the column to ``as_of``; part days are floored."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


_PARTS = {
    "extract_year": F.year, "extract_month": F.month, "extract_day": F.dayofmonth,
    "extract_weekday": lambda c: F.date_format(c, "EEEE"), "extract_hour": F.hour,
    "extract_quarter": F.quarter, "extract_week": F.weekofyear,
    "is_weekend": is_weekend, "month_name": lambda c: F.date_format(c, "MMMM"),
    "trunc_month": lambda c: F.date_trunc("month", c),
}


def date_transform(df: DataFrame, column: str, operation: str, new_name: str | None = None,
                   fmt: str = "%Y-%m-%d", as_of: Column | None = None) -> DataFrame:
    """One date function by name; dates that cannot be read give null.

    ``date_diff_today`` needs ``as_of``, so that a rerun gives the same rows.
    """
    value = to_time(df, column)
    if operation == "date_diff_today":
        if as_of is None:
            raise ValueError("date_diff_today needs as_of")
        out = days_until(value, as_of)
    elif operation == "to_string":
        out = F.date_format(value, spark_pattern(fmt))
    elif operation in _PARTS:
        out = _PARTS[operation](value)
    else:
        raise ValueError(f"unknown date operation: {operation}")
    return df.withColumn(new_name or f"{column}_{operation}", out)
