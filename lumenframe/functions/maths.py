"""Row-wise number functions; the ones that need a whole-table statistic are in operators.scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenframe.functions.columns import clip, number, safe_div, to_number, col

ROW_WISE = {
    "log": lambda c, d: F.ln(clip(c, low=1e-9)),
    "log10": lambda c, d: F.log10(clip(c, low=1e-9)),
    "sqrt": lambda c, d: F.sqrt(clip(c, low=0.0)),
    "abs": lambda c, d: F.abs(c),
    "square": lambda c, d: c * c,
    "round": lambda c, d: F.bround(c, d),
    "ceiling": lambda c, d: F.ceil(c),
    "floor": lambda c, d: F.floor(c),
    "invert": lambda c, d: safe_div(F.lit(1.0), c + F.lit(1e-9)),
    "exp": lambda c, d: F.exp(c),
}


def math_transform(df: DataFrame, column: str, operation: str, new_name: str | None = None,
                   decimals: int = 2) -> DataFrame:
    """One row-wise math function by name; text that is no number gives null."""
    if operation not in ROW_WISE:
        raise ValueError(f"unknown math operation: {operation}")
    value = ROW_WISE[operation](number(df, column), decimals)
    return df.withColumn(new_name or f"{column}_{operation}", value)


def pair_math(df: DataFrame, a: str, b: str, operation: str, name: str) -> DataFrame:
    """Two columns combined; nulls count as 0. Quotients are guarded by 1e-5."""
    x = F.coalesce(to_number(col(a)), F.lit(0.0))
    y = F.coalesce(to_number(col(b)), F.lit(0.0))
    forms = {
        "divide": F.bround(safe_div(x, y + 1e-5), 3),
        "percentage": F.bround(safe_div(x, y + 1e-5) * 100, 2),
        "multiply": x * y, "add": x + y, "subtract": x - y,
    }
    if operation not in forms:
        raise ValueError(f"unknown operation: {operation}")
    return df.withColumn(name, forms[operation])


def scale_by(df: DataFrame, column: str, factor: float, name: str) -> DataFrame:
    """The column times a factor; null counts as 0, three decimals."""
    value = F.coalesce(to_number(col(column)), F.lit(0.0)) * F.lit(float(factor))
    return df.withColumn(name, F.bround(value, 3))
