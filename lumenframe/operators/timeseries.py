"""Regular series from event tables, growth, decomposition and forecasts for many series at once.

After resampling, a series has one row per period (a century of days is 36,525 rows), so
windows inside a series are small whatever the size of the event table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lumenframe.functions.columns import col, number, numeric_columns, require, safe_div, string_columns, time_columns, to_time

UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
STEP = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTHS",
        "Y": "INTERVAL 1 YEAR"}
# Name parts of date columns and of primary metrics.
DATE_NAMES = ["date", "timestamp", "time", "day", "month", "year"]
METRIC_NAMES = ["revenue", "sales", "charge", "amount", "price", "profit"]

_AGG = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
        "median": lambda c: F.percentile(c, 0.5), "std": F.stddev_samp}


def detect_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """First time column, or text column named like one whose values all parse; then the main metric."""
    date = next(iter(time_columns(df)), None)
    if date is None:
        named = [c for c in string_columns(df) if any(w in c.lower() for w in DATE_NAMES)]
        if named:
            parse = [(F.count(col(c)) > 0) & (F.count(F.try_to_timestamp(col(c))) == F.count(col(c))) for c in named]
            date = next((c for c, dates in zip(named, df.agg(*parse).first()) if dates), None)
    numbers = numeric_columns(df)
    named = [c for c in numbers if any(w in c.lower() for w in METRIC_NAMES)]
    return date, (named or numbers or [None])[0]


def _period(df: DataFrame, date: str, freq: str) -> Column:
    if freq not in UNITS:
        raise ValueError(f"unknown frequency: {freq}")
    return F.date_trunc(UNITS[freq], to_time(df, date)).cast("timestamp_ntz")


def resample(df: DataFrame, date: str, value: str, freq: str = "M", agg: str = "sum", by: Sequence[str] = (),
             label: str = "start") -> DataFrame:
    """One row per period from the first to the last of each series; empty periods are 0 for sums and
    counts, else null. ``label="end"`` shows the last day of the period."""
    require(df, [date, value, *by])
    if agg not in _AGG:
        raise ValueError(f"unknown aggregate: {agg}")
    keys = [col(b) for b in by]
    rows = df.select(*keys, _period(df, date, freq).alias("period"), number(df, value).alias("v")).where("period is not null")
    if by:
        rows = rows.dropna(subset=list(by))
    found = rows.groupBy(*keys, "period").agg(_AGG[agg]("v").alias("value"))
    # A period stands for itself and the empty ones up to the next, so the regular rows are never shuffled.
    step = F.expr(STEP[freq])
    following = F.lead("period").over(_series(by))
    spaced = found.select(*keys, "period", "value", F.coalesce(following - step, F.col("period")).alias("until"))
    out = spaced.select(*keys, "value", F.posexplode(F.sequence("period", "until", step)).alias("place", "period"))
    value = F.when(F.col("place") == 0, F.col("value"))
    out = out.select(*keys, "period", (F.coalesce(value, F.lit(0)) if agg in ("sum", "count") else value).alias("value"))
    if label == "end":
        shift = {"D": F.col("period"), "W": F.col("period") + F.expr("INTERVAL 6 DAYS"),
                 "M": F.last_day("period"), "Q": F.last_day(F.add_months("period", 2)),
                 "Y": F.last_day(F.add_months("period", 11))}
        out = out.withColumn("period", shift[freq].cast("timestamp_ntz"))
    return out


def _series(by: Sequence[str]):
    return W.partitionBy(*[col(b) for b in by]).orderBy("period")


def growth(df: DataFrame, date: str, metric: str, freq: str = "M", by: Sequence[str] = ()) -> DataFrame:
    """Totals per period with percent change to the period before (0 in the first one)."""
    series = resample(df.dropna(subset=[metric]), date, metric, freq, "sum", by)
    before = F.lag("value").over(_series(by))
    return series.withColumn("growth_pct", F.coalesce(safe_div((F.col("value") - before) * 100, before), F.lit(0.0)))


def growth_summary(df: DataFrame, date: str, metric: str, freq: str = "M", by: Sequence[str] = ()) -> DataFrame:
    """Latest and average growth per series; above 5 accelerating, below -5 decelerating."""
    series = resample(df.dropna(subset=[metric]), date, metric, freq, "sum", by)
    before = F.lag("value").over(_series(by))
    changes = series.withColumn("g", safe_div((F.col("value") - before) * 100, before)).where("g is not null")
    out = changes.groupBy(*[col(b) for b in by]).agg(
        F.max_by("g", "period").alias("recent_growth_pct"), F.avg("g").alias("average_growth_pct"))
    g = F.col("recent_growth_pct")
    return out.withColumn("trend", F.when(g > 5, "Accelerating").when(g < -5, "Decelerating").otherwise("Stable"))


def decompose(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trend (centred mean of four periods, or fewer in a shorter series) and the rest."""
    w = _series(by)
    size = F.count(F.lit(1)).over(W.partitionBy(*[col(b) for b in by]))
    frames = {n: F.avg("value").over(w.rowsBetween(-(n // 2), (n - 1) // 2)) for n in (1, 2, 3, 4)}
    trend = F.when(size >= 4, frames[4]).when(size == 3, frames[3]).when(size == 2, frames[2]).otherwise(frames[1])
    return series.withColumn("trend", trend).withColumn("residual", F.col("value") - F.col("trend"))


SHORTEST = 6  # periods that a series needs for a forecast


def _history(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per series: its values in time order, and the last period."""
    ordered = F.array_sort(F.collect_list(F.struct("period", F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))))
    return series.groupBy(*[col(b) for b in by]).agg(ordered.alias("h")).select(
        *[col(b) for b in by], F.transform("h", lambda x: x["value"]).alias("y"),
        F.element_at("h", -1)["period"].alias("last_period"))


def _smooth(y: Column, alpha: float) -> Column:
    first = F.get(y, F.lit(0))
    return F.aggregate(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), first,
                       lambda level, v: alpha * v + (1 - alpha) * level)


def _holt_winters(y: Column, horizon: int, season: int, alpha: float, beta: float, gamma: float) -> Column:
    """Additive level, trend and season as a fold over the values; an array of forecasts.

    Level, trend and season start from two full seasons; a shorter series has null forecasts.
    """
    base = F.aggregate(F.slice(y, 1, season), F.lit(0.0), lambda a, v: a + v) / season
    second = F.aggregate(F.slice(y, season + 1, season), F.lit(0.0), lambda a, v: a + v) / season
    start = F.struct(base.alias("level"), ((second - base) / season).alias("trend"),
                     F.transform(F.slice(y, 1, season), lambda v: v - base).alias("s"))

    def step(state: Column, v: Column) -> Column:
        oldest = F.get(state["s"], F.lit(0))
        level = alpha * (v - oldest) + (1 - alpha) * (state["level"] + state["trend"])
        trend = beta * (level - state["level"]) + (1 - beta) * state["trend"]
        fresh = gamma * (v - level) + (1 - gamma) * oldest
        return F.struct(level.alias("level"), trend.alias("trend"),
                        F.concat(F.slice(state["s"], 2, season - 1), F.array(fresh)).alias("s"))

    out = F.aggregate(F.slice(y, season + 1, F.greatest(F.size(y) - season, F.lit(0))), start, step,
                      lambda state: F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: state["level"] +
                                                h * state["trend"] + F.get(state["s"], ((h - 1) % season).cast("int"))))
    return F.when(F.size(y) >= 2 * season, out).otherwise(_unknown(horizon))


def _unknown(horizon: int) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), horizon)


def _predict(y: Column, horizon: int, algorithm: str, alpha: float, window: int, season: int) -> Column:
    flat = F.lit(horizon)
    if algorithm == "exponential_smoothing":
        return F.array_repeat(_smooth(y, alpha), flat)
    if algorithm == "moving_average":
        last = F.slice(y, -F.least(F.lit(window), F.size(y)), F.lit(window))
        return F.array_repeat(F.aggregate(last, F.lit(0.0), lambda a, v: a + v) / F.size(last), flat)
    if algorithm == "holt_winters":
        return _holt_winters(y, horizon, season, alpha, 0.1, 0.1)
    raise ValueError(f"unknown algorithm: {algorithm}")


def _errors(actual: Column, predicted: Column) -> dict[str, Column]:
    pairs = F.arrays_zip(actual.alias("a"), predicted.alias("p"))
    size = F.size(actual)

    def mean(fn) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda t, x: t + fn(x["a"], x["p"])) / size

    return {"mae": mean(lambda a, p: F.abs(a - p)), "rmse": F.sqrt(mean(lambda a, p: (a - p) * (a - p))),
            "mape_pct": mean(lambda a, p: F.abs(F.try_divide(a - p, a + 1e-6))) * 100}


def _bands(df: DataFrame, by: Sequence[str], freq: str) -> DataFrame:
    months = {"M": 1, "Q": 3, "Y": 12}
    if freq in months:
        start = F.add_months(F.col("last_period"), F.col("step") * months[freq]).cast("timestamp_ntz")
    else:
        start = F.date_add(F.col("last_period"), F.col("step") * (7 if freq == "W" else 1)).cast("timestamp_ntz")
    f, e = F.col("forecast"), F.col("rmse")
    known = f.isNotNull() & e.isNotNull()
    return df.select(*[col(b) for b in by], "step", start.alias("period"), "forecast",
                     F.when(known, F.greatest(F.lit(0.0), f - 1.28 * e)).alias("lower_80"), (f + 1.28 * e).alias("upper_80"),
                     F.when(known, F.greatest(F.lit(0.0), f - 1.96 * e)).alias("lower_95"), (f + 1.96 * e).alias("upper_95"))


def backtest(series: DataFrame, algorithm: str = "exponential_smoothing", by: Sequence[str] = (), alpha: float = 0.3,
             window: int = 4, season: int = 12) -> DataFrame:
    """Errors on the last fifth of each series (1 to 6 periods), fitted on the part before.

    Series shorter than six periods have null errors; for Holt-Winters so do those whose part
    before holds less than two seasons.
    """
    h = _history(series, by)
    test = F.least(F.lit(6), F.greatest(F.lit(1), F.floor(F.size("y") * 0.2))).cast("int")
    h = h.withColumn("test", test).withColumns({
        "train": F.slice("y", F.lit(1), F.size("y") - F.col("test")), "actual": F.slice("y", F.size("y") - F.col("test") + 1, F.col("test"))})
    guess = F.when(F.size("y") >= SHORTEST, _predict(F.col("train"), 6, algorithm, alpha, window, season)).otherwise(_unknown(6))
    predicted = F.slice(guess, F.lit(1), F.col("test"))
    h = h.withColumn("predicted", predicted)
    errors = _errors(F.col("actual"), F.col("predicted"))
    return h.select(*[col(b) for b in by], F.size("y").alias("periods"), F.col("test").alias("test_periods"),
                    *[e.alias(n) for n, e in errors.items()])


def forecast(series: DataFrame, horizon: int = 12, freq: str = "M", algorithm: str = "exponential_smoothing",
             by: Sequence[str] = (), alpha: float = 0.3, window: int = 4, season: int = 12) -> DataFrame:
    """Future periods per series with 80 and 95 percent bands from the backtest error.

    Series shorter than six periods, or than two seasons for Holt-Winters, have null forecasts;
    where the backtest has no error the bands are null.
    """
    h = _history(series, by)
    guess = F.when(F.size("y") >= SHORTEST, _predict(F.col("y"), horizon, algorithm, alpha, window, season)).otherwise(_unknown(horizon))
    future = h.withColumn("f", guess).select(
        *[col(b) for b in by], "last_period", F.posexplode("f").alias("at", "forecast"))
    future = future.withColumn("step", F.col("at") + 1)
    scores = backtest(series, algorithm, by, alpha, window, season)
    if by:
        future = future.join(scores.select(*[col(b) for b in by], "rmse"), list(by))
    else:
        future = future.withColumn("rmse", scores.select("rmse").scalar())
    return _bands(future.withColumn("forecast", F.when(F.col("forecast").isNotNull(), F.greatest(F.lit(0.0), F.col("forecast"))))
                  if algorithm != "exponential_smoothing" else future, by, freq)


def forecast_boosted(series: DataFrame, horizon: int = 12, freq: str = "M", by: Sequence[str] = (),
                     trees: int = 100, learning_rate: float = 0.08, seed: int = 42) -> DataFrame:
    """Boosted trees on the last three values and the time index, predicted step by step.

    One model is trained on the lag rows of all series. Every step predicts all series at
    once, and its result becomes the next step's first lag. Series of ten periods or fewer have
    null forecasts.
    """
    keys = [col(b) for b in by]
    packer = VectorAssembler(inputCols=["l1", "l2", "l3", "t"], outputCol="features")

    def lag_rows(part: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("t")
        return part.select(*keys, "t", "y", *[F.lag("y", i).over(w).alias(f"l{i}") for i in (1, 2, 3)]).dropna()

    def fit(part: DataFrame):
        return GBTRegressor(featuresCol="features", labelCol="y", maxIter=trees, stepSize=learning_rate, maxDepth=3,
                            seed=seed).fit(packer.transform(lag_rows(part)))

    def roll(part: DataFrame, model, steps: int) -> DataFrame:
        state = part.groupBy(*keys).agg(
            F.max_by("y", "t").alias("l1"), F.max("t").alias("last_t"),
            F.max_by("y", F.when(F.col("t") < F.col("n") - 1, F.col("t"))).alias("l2"),
            F.max_by("y", F.when(F.col("t") < F.col("n") - 2, F.col("t"))).alias("l3"))
        names = []
        for i in range(1, steps + 1):
            step = packer.transform(state.withColumn("t", F.col("last_t") + i))
            state = model.transform(step).withColumn(f"f{i}", F.col("prediction")).drop("features", "prediction", "t")
            state = state.withColumn("l3", F.col("l2")).withColumn("l2", F.col("l1")).withColumn("l1", F.col(f"f{i}"))
            names.append(f"f{i}")
        return state.select(*keys, F.array(*names).alias("f"))

    numbered = series.select(*keys, "period", F.coalesce("value", F.lit(0.0)).cast("double").alias("y"),
                             (F.row_number().over(_series(by)) - 1).alias("t"),
                             F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("size"))
    short = numbered.where("size <= 10").groupBy(*keys).agg(F.max("period").alias("last_period"))
    none = F.lit(None).cast("double")
    short = _bands(short.select(*keys, "last_period", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), none.alias("forecast"), none.alias("rmse")), by, freq)
    if not by:
        short = short.where("period is not null")
    numbered = numbered.where("size > 10")
    if numbered.isEmpty():
        return short
    test = F.least(F.lit(6), F.greatest(F.lit(1), F.floor(F.col("size") * 0.2))).cast("int")
    numbered = numbered.withColumn("test", test)
    train = numbered.where(F.col("t") < F.col("size") - F.col("test")).withColumn("n", F.col("size") - F.col("test"))
    held = numbered.where(F.col("t") >= F.col("size") - F.col("test"))
    actual = held.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"]).alias("a"))
    full = numbered.withColumn("n", F.col("size"))
    tested, future = roll(train, fit(train), 6), roll(full, fit(full), horizon)
    last = full.groupBy(*keys).agg(F.max("period").alias("last_period"))
    if by:
        scored = tested.join(actual, list(by))
        future = future.join(last, list(by))
    else:
        scored = tested.withColumn("a", actual.scalar())
        future = future.withColumn("last_period", last.scalar())
    rmse = scored.select(*keys, _errors(F.col("a"), F.slice("f", F.lit(1), F.size("a")))["rmse"].alias("rmse"))
    future = future.join(rmse, list(by)) if by else future.withColumn("rmse", rmse.scalar())
    out = future.select(*keys, "last_period", "rmse", F.posexplode("f").alias("at", "raw"))
    return _bands(out.withColumns({"step": F.col("at") + 1, "forecast": F.greatest(F.lit(0.0), F.col("raw"))}), by, freq).union(short)
