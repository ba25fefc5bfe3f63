"""Column summaries that are kept per period and merged, instead of profiles of whole tables.

One aggregate with map-side combine gives every period one row for each column: counts, sums and
two sketches. A sketch has a bounded size, so what is shuffled does not grow with the values, and
no value is shuffled at all. Summaries of any periods merge into one of all their rows. Distinct
counts come from HyperLogLog, quantiles from KLL sketches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumenframe.functions.columns import col, is_missing, is_numeric, normalise_missing, number, require, time_columns

LOG_REGISTERS, KLL_SIZE = 12, 200       # a distinct count has a standard error of 1.6 percent, a rank one of 1.4
DISTINCT_ERROR, RANK_ERROR = 0.05, 0.03  # three and two of them
FIELDS = "rows long, missing long, total double, squares double, least double, greatest double, distinct_sketch binary, quantile_sketch binary"


def summarise(df: DataFrame, columns: Sequence[str] | None = None, time: str | None = None, period: str = "day") -> DataFrame:
    """(period, column, rows, missing, total, squares, least, greatest, distinct_sketch, quantile_sketch).

    Rows whose ``time`` is null form the period null; without ``time`` all rows do. NaN counts as
    missing, -0.0 as 0.0. Numbers have moments and quantiles; of other columns the distinct values
    are counted. A column without values has null moments and sketches of nothing.
    """
    columns = list(columns or [c for c in df.columns if c != time])
    require(df, [*columns, *([time] if time else [])])
    missing = {c: is_missing(df, c) for c in columns}
    clean = df if time is None else df.withColumn("__period", F.date_trunc(period, col(time)).cast("timestamp_ntz"))
    clean = normalise_missing(clean)
    span = F.col("__period") if time else F.lit(None).cast("timestamp_ntz")

    def facts(c: str) -> Column:
        numeric = is_numeric(df, c)
        v = number(df, c) if numeric else F.lit(None).cast("double")
        v = F.when(v == 0, F.lit(0.0)).otherwise(v)
        return F.struct(
            F.count(F.lit(1)).alias("rows"), F.count_if(missing[c]).alias("missing"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
            F.min(v).alias("least"), F.max(v).alias("greatest"), F.hll_sketch_agg(col(c).cast("string"), LOG_REGISTERS).alias("distinct_sketch"),
            F.kll_sketch_agg_double(v, KLL_SIZE).alias("quantile_sketch"))

    wide = clean.groupBy(span.alias("period")).agg(*[facts(c).alias(f"c{i}") for i, c in enumerate(columns)])
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("f")) for i, c in enumerate(columns)]))
    return wide.select("period", long.alias("x")).select("period", "x.column", "x.f.*")


def merge(summaries: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Summaries of the same ``by`` as one: that of all their rows."""
    return summaries.groupBy(*[col(b) for b in by]).agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch", KLL_SIZE).alias("quantile_sketch"))


def read_out(summaries: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The numbers of a profile: rows, missing, mean, deviation, ends, and estimates of distinct values and quantiles."""
    n = (F.col("rows") - F.col("missing")).cast("double")
    mean = F.try_divide(F.col("total"), n)
    filled = F.col("total").isNotNull()
    spread = F.when(filled & (n > 1), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares") - n * mean * mean, n - 1))))
    filled = filled & (F.kll_sketch_get_n_double("quantile_sketch") > 0)
    known = [c for c in summaries.columns if c not in ("rows", "missing", "total", "squares", "least", "greatest", "distinct_sketch", "quantile_sketch")]
    return summaries.select(
        *[col(c) for c in known], "rows", "missing", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), mean.alias("mean"), spread.alias("std"),
        F.col("least").alias("min"), F.col("greatest").alias("max"),
        *[F.when(filled, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(q)))).alias(f"q{round(100 * q):02d}") for q in quantiles])


def keep(summaries: DataFrame, path: str, folder: str = "yyyyMM") -> None:
    """Writes summaries below ``path``. Periods that share a ``folder`` (a pattern of dates) are written together and replace those there."""
    named = summaries.withColumn("kept", F.coalesce(F.date_format("period", folder), F.lit("none")))
    named.repartition("kept").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kept").parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The summaries below ``path``."""
    schema = T.StructType.fromDDL(f"period timestamp_ntz, column string, {FIELDS}")
    return spark.read.schema(schema).parquet(path)
