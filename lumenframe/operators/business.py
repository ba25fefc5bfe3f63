"""Goal tracking, insights, KPI analysis and ready-made questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumenframe.functions.columns import col, number, numeric_columns, safe_div, string_columns
from lumenframe.operators.aggregates import best_and_worst, concentration, kpi_totals, segment_leaderboard
from lumenframe.operators.correlation import pearson_pairs
from lumenframe.operators.ordered import with_row_number
from lumenframe.operators.profile import audit_quality, id_columns, outside_counts, value_facts, wide_facts
from lumenframe.operators.quantiles import column_quantiles
from lumenframe.operators.timeseries import resample

INSIGHT = "kind string, subject string, value double, detail string"


def goal_status(pct: Column) -> Column:
    return (F.when(pct >= 105, "Exceeded Target").when(pct >= 95, "On Track").when(pct >= 80, "At Risk")
            .otherwise("Lagging Behind Target"))


def goal_tracking(df: DataFrame, metric: str, target: float) -> DataFrame:
    """Actual against target with variance, percent and status."""
    total = df.agg(F.coalesce(F.sum(number(df, metric)), F.lit(0.0)).alias("actual"))
    pct = F.coalesce(safe_div(F.col("actual") * 100, F.lit(float(target))), F.lit(0.0))
    return total.select("actual", F.lit(float(target)).alias("target"), (F.col("actual") - target).alias("variance"),
                        pct.alias("pct_achieved"), goal_status(F.round(pct, 1)).alias("status"))


def goal_segments(df: DataFrame, metric: str, target: float, dimension: str) -> DataFrame:
    """Each segment against an equal share of the target."""
    sums = df.dropna(subset=[dimension]).groupBy(col(dimension).alias("segment")).agg(
        F.coalesce(F.sum(number(df, metric)), F.lit(0.0)).alias("actual"))
    share = F.lit(float(target)) / F.greatest(F.lit(1), sums.agg(F.count(F.lit(1))).scalar())
    out = sums.withColumn("target", share)
    return out.withColumns({"variance": F.col("actual") - F.col("target"),
                            "pct_achieved": F.coalesce(safe_div(F.col("actual") * 100, F.col("target")), F.lit(0.0))})


def insights(df: DataFrame, dimension: str | None = None, metric: str | None = None) -> DataFrame:
    """Top and bottom segment, concentration of at least 65 percent, values beyond 3 IQR."""
    numbers, texts = numeric_columns(df), string_columns(df)
    dimension, metric = dimension or (texts or [None])[0], metric or (numbers or [None])[0]
    out = []
    if dimension and metric:
        total = df.dropna(subset=[dimension]).agg(F.sum(number(df, metric))).first()[0]
        best = best_and_worst(df, dimension, metric).first()
        if best["top"] is not None and best["top"] != best["bottom"]:
            share = 100 * best["top_total"] / total if total > 0 else 0.0
            out.append(("top_driver", str(best["top"]), share, f"{best['ratio']:.1f} times {best['bottom']}"))
            top = concentration(df, dimension, metric).first()
            if top["top_pct"] is not None and top["top_pct"] >= 65:
                out.append(("concentration", dimension, top["top_pct"], f"{top['segments']} segments"))
    watched = list(dict.fromkeys([metric, *numbers] if metric else numbers))[:2]
    _, wide = wide_facts(df)
    bounds = {c: (a - 3 * (b - a), b + 3 * (b - a))
              for c, (a, b) in column_quantiles(df, watched, [0.25, 0.75]).items() if a is not None}
    out += [("extreme_values", c, float(n), f"max {wide[c]['max']}") for c, n in outside_counts(df, bounds).items() if n]
    return df.sparkSession.createDataFrame(out, INSIGHT)


def kpi_export(df: DataFrame, metrics: Sequence[str], order_by) -> DataFrame:
    """Total, average and growth of the second half of the known values over the first, per metric."""
    out = None
    for m in metrics:
        known = df.select(*[col(c) for c in df.columns], number(df, m).alias("__v")).where("__v is not null")
        half = F.floor(known.agg(F.count(F.lit(1))).scalar() / 2)
        early = F.col("__row") <= half
        one = with_row_number(known, order_by, name="__row").agg(
            F.lit(m).alias("metric"), F.sum("__v").alias("total"), F.avg("__v").alias("average"),
            F.avg(F.when(early, F.col("__v"))).alias("first_half"), F.avg(F.when(~early, F.col("__v"))).alias("second_half"))
        one = one.withColumn("growth_pct", F.coalesce(safe_div(
            (F.col("second_half") - F.col("first_half")) * 100, F.abs("first_half")), F.lit(0.0)))
        one = one.withColumn("status", F.when(F.col("growth_pct") >= 0, "Positive").otherwise("Decline"))
        out = one if out is None else out.unionByName(one)
    return out


def kpi_segments(df: DataFrame, dimension: str, metric: str, top: int = 8) -> DataFrame:
    return segment_leaderboard(df, dimension, metric, top).select("segment", "total", "share_pct")


def kpi_anomalies(df: DataFrame, metrics: Sequence[str], factor: float = 2.5) -> DataFrame:
    """Values beyond 2.5 IQR per metric."""
    bounds = {c: (a - factor * (b - a), b + factor * (b - a))
              for c, (a, b) in column_quantiles(df, metrics, [0.25, 0.75]).items() if a is not None}
    return df.sparkSession.createDataFrame([(c, n) for c, n in outside_counts(df, bounds).items() if n],
                                           "metric string, anomalies long")


def dashboard(df: DataFrame, metric: str, dimension: str, date: str, freq: str = "M") -> dict[str, DataFrame]:
    """Tables behind an overview page: KPIs, bars, shares and trend."""
    board = segment_leaderboard(df, dimension, metric)
    return {"kpis": kpi_totals(df, metric), "bars": board.select("segment", "total"),
            "shares": board.select("segment", "share_pct"), "trend": resample(df, date, metric, freq)}


def top_segments(df: DataFrame, dimension: str, metric: str, n: int = 10) -> DataFrame:
    """"Top n ... by": largest totals."""
    return segment_leaderboard(df, dimension, metric, n).select("segment", "total", "n")


def avg_by(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """"Average ... by": mean per segment, highest first."""
    v = number(df, metric)
    return (df.dropna(subset=[dimension]).groupBy(col(dimension).alias("segment"))
            .agg(F.avg(v).alias("average"), F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_last("average"), "segment"))


def monthly_trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """"Monthly trend": rows, mean and total per month that occurs."""
    v = number(df, metric)
    return (df.where(col(date).isNotNull()).groupBy(F.date_trunc("month", col(date)).cast("timestamp_ntz").alias("month"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("average"), F.sum(v).alias("total")).orderBy("month"))


def segment_summary(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """The default answer: rows, total, mean and range per segment."""
    v = number(df, metric)
    return (df.dropna(subset=[dimension]).groupBy(col(dimension).alias("segment"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("average"),
                 F.min(v).alias("min"), F.max(v).alias("max")).orderBy(F.desc("n"), "segment"))


def findings(df: DataFrame) -> DataFrame:
    """Strongest pair, number of collinear pairs, skew beyond 1.5, columns with a value per row."""
    out = []
    if len(numeric_columns(df)) >= 2:
        pairs = pearson_pairs(df)
        top = pairs.orderBy(F.abs("coefficient").desc(), "var1", "var2").first()
        if top:
            out.append(("strongest_pair", f"{top['var1']} & {top['var2']}", top["coefficient"], top["strength"]))
        close = pairs.where("collinear").count()
        if close:
            out.append(("collinear_pairs", "table", float(close), "|r| >= 0.8"))
    _, wide = wide_facts(df)
    out += [("severe_skew", c, f["skew"], "") for c, f in wide.items() if abs(f.get("skew") or 0.0) > 1.5]
    out += [("unique_id", c, None, "one value per row") for c in id_columns(df)]
    return df.sparkSession.createDataFrame(out, INSIGHT)


def signals(df: DataFrame) -> DataFrame:
    """Flags from the audit: health band, duplicates, gaps, constants, outliers, skew, leader, dominance."""
    audit = audit_quality(df)
    s = audit["summary"].first()
    score = s["quality_score"]
    out = [("health", "table", float(score), "Excellent" if score >= 85 else "Fair" if score >= 65 else "Poor")]
    if s["duplicate_rows"]:
        out.append(("duplicates", "table", float(s["duplicate_rows"]), f"{s['duplicate_pct']} %"))
    if s["missing_cells"]:
        out.append(("missing", "table", float(s["missing_cells"]), ""))
    out += [("constant", c, None, "") for c in s["constant_columns"]]
    out += [("outliers", r["column"], float(r["iqr_outliers"]), "") for r in audit["outliers"].collect() if r["iqr_outliers"]]
    rows, wide = wide_facts(df)
    skews = {c: f["skew"] for c, f in wide.items() if abs(f.get("skew") or 0.0) > 1.2}
    out += [("skew", c, v, "") for c, v in skews.items()]
    spread = {c: f["std"] for c, f in wide.items() if f.get("std") is not None}
    if spread:
        widest = max(spread, key=spread.get)
        out.append(("widest_spread", widest, spread[widest], ""))
    for c, f in value_facts(df, string_columns(df)).items():
        known = rows - wide[c]["missing"]
        if known and f["top_n"] / known > 0.75:
            out.append(("dominant_value", c, 100 * f["top_n"] / known, str(f["top"])))
    return df.sparkSession.createDataFrame(out, INSIGHT)
