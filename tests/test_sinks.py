"""Streams that stop, start again and repeat a batch."""

import os

from pyspark.sql import functions as F

from lumenframe.operators import timeseries as ts
from lumenframe.streaming import sinks, windows as st

EVENTS = "event_id long, ts timestamp, value double"


def arrive(spark, folder, part, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "event_id long").select("event_id", (F.timestamp_seconds(F.col("event_id") * 60)).alias("ts"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(f"{folder}/in/{part}")


def test_a_repeated_batch_takes_its_own_place(spark, tmp_path):
    folder = str(tmp_path)
    for part, ids in enumerate([range(5), range(5, 9), range(9, 12)]):
        arrive(spark, folder, part, ids)
    stream = st.read_event_files(spark, f"{folder}/in/*", EVENTS).select("event_id")
    sinks.start(stream, folder).awaitTermination()
    once = sorted(r.event_id for r in sinks.read_batches(spark, folder, stream.schema).collect())
    assert once == list(range(12)) and len(os.listdir(f"{folder}/rows")) == 3
    # As after a crash between the rows and the commit: the last batch is run again from its offsets.
    last = max(int(f) for f in os.listdir(f"{folder}/state/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        path = f"{folder}/state/commits/{name}"
        if os.path.exists(path):
            os.remove(path)
    arrive(spark, folder, 3, range(12, 14))
    sinks.start(stream, folder).awaitTermination()
    assert sorted(r.event_id for r in sinks.read_batches(spark, folder, stream.schema).collect()) == list(range(14))


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    folder = str(tmp_path)
    sinks.write_batch(spark.range(3).toDF("n"), 0, folder)
    sinks.write_batch(spark.range(9).toDF("n"), 1, folder)
    os.remove(f"{folder}/rows/{sinks.BATCH}=1/_SUCCESS")
    assert sinks.read_batches(spark, folder, "n long").count() == 3
    sinks.write_batch(spark.range(2).toDF("n"), 1, folder)
    sinks.write_batch(spark.range(2).toDF("n"), 1, folder)
    assert sinks.read_batches(spark, folder, "n long").count() == 5
    assert sinks.read_batches(spark, folder, "n long", last_only=True).count() == 2
    assert sinks.read_batches(spark, str(tmp_path / "none"), "n long").count() == 0


def test_complete_mode_keeps_the_last_result(spark, tmp_path):
    folder = str(tmp_path)
    for part, ids in enumerate([range(100), range(50, 300)]):
        arrive(spark, folder, part, ids)
    stream = st.windowed_kpis(st.read_event_files(spark, f"{folder}/in/*", EVENTS), "ts", [], "value", "1 hour")
    sinks.start(stream, folder, "complete").awaitTermination()
    got = sinks.read_batches(spark, folder, stream.schema, last_only=True)
    assert got.agg(F.sum("n")).first()[0] == 350 and got.count() == 5


def test_boosted_forecasts_cover_every_series(spark):
    rows = [(size, i, float(i % 4 + size)) for size in (1, 5, 10, 11, 24) for i in range(size)]
    series = spark.createDataFrame(rows, "s int, i int, value double").select("s", F.expr("cast(add_months(date '2020-01-01', i) as timestamp_ntz)").alias("period"), "value")
    got = ts.forecast_boosted(series, 2, "M", ["s"], trees=2).collect()
    assert sorted((r.s, r.step) for r in got) == [(s, h) for s in (1, 5, 10, 11, 24) for h in (1, 2)]
    assert all((r.forecast is None) == (r.s <= 10) and (r.upper_95 is None) == (r.s <= 10) for r in got)
    assert all(r.period is not None for r in got)
    alone = ts.forecast_boosted(series.where("s = 5").drop("s"), 3, "M", trees=2).collect()
    assert [r.step for r in alone] == [1, 2, 3] and all(r.forecast is None for r in alone)
