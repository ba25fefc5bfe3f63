"""Event-time summaries, rule checks, deduplication and scoring.

Every function takes a streaming or a batch table. Watermarks only act on streams, so a
batch run gives the result the stream converges to.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.functions.columns import col, number
from lumenframe.operators.ordered import layout, over_rows, running
from lumenframe.operators.quality import violates


def read_event_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files landing in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _event_time(df: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need a timestamp with time zone; times without one are read as UTC session time."""
    out = df.withColumn(time, col(time).cast("timestamp"))
    return out.withWatermark(time, late)


def windowed_kpis(df: DataFrame, time: str, by: Sequence[str], metric: str, size: str = "1 hour",
                  slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean per (sliding) window and key."""
    events = _event_time(df, time, late)
    v = number(events, metric)
    w = F.window(col(time), size, slide) if slide else F.window(col(time), size)
    out = events.groupBy(w.alias("w"), *[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *[col(b) for b in by], "n", "total", "mean")


def sessions(df: DataFrame, time: str, user: str, metric: str, gap: str = "30 minutes", late: str = "10 minutes",
             key: str | None = None) -> DataFrame:
    """Events and total per user session; a session ends after ``gap`` without an event.

    A batch table needs a unique ``key``: sessions are then numbered with ordered scans, so the
    events of a hot user are not brought to one task.
    """
    if df.isStreaming:
        events = _event_time(df, time, late)
        out = events.groupBy(F.session_window(col(time), gap).alias("w"), col(user)).agg(
            F.count(F.lit(1)).alias("n"), F.sum(number(events, metric)).alias("total"))
        return out.select(col(user), F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
    if key is None:
        raise ValueError("sessions of a batch table need key")
    order = [time, key]
    events = df.where(col(time).isNotNull()).select(col(user), col(time), col(key), number(df, metric).alias("__v"))
    plan = layout(events, order, [user])
    spaced = over_rows(events, {}, 0, 0, order, [user], shifts={"__previous": (time, 1)}, shared=plan)
    starts = (F.col("__previous").isNull() | (col(time) >= F.col("__previous") + F.expr(f"INTERVAL {gap}"))).cast("int")
    numbered = running(spaced.withColumn("__new", starts), {"__session": ("sum", "__new")}, order, [user], shared=plan)
    out = numbered.groupBy(col(user), "__session").agg(
        F.min(col(time)).alias("session_start"), (F.max(col(time)) + F.expr(f"INTERVAL {gap}")).alias("session_end"),
        F.count(F.lit(1)).alias("n"), F.sum("__v").alias("total"))
    return out.drop("__session")


def rule_violations(df: DataFrame, time: str, rules: Sequence[Mapping], size: str = "1 hour",
                    late: str = "10 minutes") -> DataFrame:
    """Rows and violations per window and rule."""
    events = _event_time(df, time, late)
    tests = [(i + 1, r, violates(events, r)) for i, r in enumerate(rules)]
    flags = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r["column"]).alias("column"), F.lit(r["rule_type"]).alias("rule_type"),
                               (F.lit(True) if t is None else t).alias("broken")) for i, r, t in tests])
    long = events.select(col(time), F.explode(flags).alias("x"))
    out = long.groupBy(F.window(col(time), size).alias("w"), "x.rule", "x.column", "x.rule_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("x.broken").alias("violations"))
    return out.select(F.col("w.start").alias("window_start"), "rule", "column", "rule_type", "n", "violations")


def dedup_events(df: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """One row per key: within the watermark on a stream, overall on a batch table."""
    if df.isStreaming:
        return _event_time(df, time, late).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def score_stream(df: DataFrame, model_path: str) -> DataFrame:
    """A saved model applied to every row."""
    return PipelineModel.load(model_path).transform(df)


def broken_rows(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Rows that break at least one rule."""
    tests = [t for t in (violates(df, r) for r in rules) if t is not None]
    return df.where(reduce(lambda a, b: a | b, tests)) if tests else df.limit(0)
