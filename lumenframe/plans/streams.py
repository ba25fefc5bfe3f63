"""Event-time summaries: batch runs checked by SQL, and real streams over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.plans.registry import query, r, show, table
from lumenframe.streaming import sinks, windows as st

KPIS = f"""
select cast(time_bucket(interval '6 hours', ts) as timestamp) as window_start, cast(time_bucket(interval '6 hours', ts) + interval '6 hours' as timestamp) as window_end,
  event_type, cast(count(*) as bigint) as n, {r('sum(value)', 2)} as total, {r('avg(value)', 3)} as mean from events group by 1, 2, 3"""


def _plain(df, *times):
    out = df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})
    return out


def _kpi_table(df):
    out = _plain(df, "window_start", "window_end")
    return show(out.withColumn("mean", F.round(F.col("mean") + 3e-7, 3)), 4).withColumn("total", F.round(F.col("total"), 2))


@query("R1_windowed_kpis", KPIS)
def kpis(spark, d):
    return _kpi_table(st.windowed_kpis(table(spark, d, "events"), "ts", ["event_type"], "value", "6 hours"))


@query("R1_sliding_kpis", f"""
with w as (select unnest([time_bucket(interval '3 hours', ts), time_bucket(interval '3 hours', ts) - interval '3 hours']) as s, event_type, value from events)
select cast(s as timestamp) as window_start, event_type, cast(count(*) as bigint) as n from w group by 1, 2""")
def sliding(spark, d):
    out = st.windowed_kpis(table(spark, d, "events"), "ts", ["event_type"], "value", "6 hours", "3 hours")
    return _plain(out, "window_start").select("window_start", "event_type", "n")


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


# Events as they arrive: a file for every third day; each 6th event comes twice, the copy a file later, each 35th only
# comes three files, nine days, too late. Watermarks lag two days and more, so copies are in time and the late are not.
PARTS = 10
ARRIVALS = f"""(select *, least(cast(floor((epoch(ts) - 1704067200) / 259200) as int), {PARTS} - 1) + case when event_id % 35 = 0 then 3 else 0 end as part from events
  union all select *, least(cast(floor((epoch(ts) - 1704067200) / 259200) as int), {PARTS} - 1) + 1 from events where event_id % 6 = 0 and event_id % 35 <> 0)"""


def _arrivals(spark, d):
    """The events as a stream that reads one file after the other, late and repeated rows among them."""
    events = table(spark, d, "events")
    day = F.least(F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 259200).cast("int"), F.lit(PARTS - 1))
    late = F.col("event_id") % 35 == 0
    dealt = events.withColumn("part", day + F.when(late, 3).otherwise(0)).union(
        events.where((F.col("event_id") % 6 == 0) & ~late).withColumn("part", day + 1))
    folder = sinks.new_folder(spark, "arrivals")
    dealt = dealt.repartition("part").persist()
    for part in range(PARTS + 3):  # one after the other: the stream reads files in the order of their times
        dealt.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(f"{folder}/{part:02d}")
    dealt.unpersist()
    return st.read_event_files(spark, f"{folder}/*", events.schema)


def _in_time(end: str, late: str) -> str:
    """SQL for the arrivals that a stateful step takes: ``end`` lies after the watermark of the batch before."""
    return f"""seen as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 2 preceding) as mark from {ARRIVALS} group by part),
  taken as (select a.* from {ARRIVALS} a join seen using (part) where mark is null or {end} > mark - interval '{late}'),
  final as (select max(ts) - interval '{late}' as mark from {ARRIVALS})"""


@query("R1_append_kpis_with_late_rows", f"""
with {_in_time("time_bucket(interval '6 hours', ts) + interval '6 hours'", '2 days')}
select cast(time_bucket(interval '6 hours', ts) as timestamp) as window_start, event_type, cast(count(*) as bigint) as n, {r('sum(value)', 2)} as total
from taken, final group by 1, 2, mark having time_bucket(interval '6 hours', min(ts)) + interval '6 hours' <= mark""")
def append_kpis(spark, d):
    out = sinks.run(st.windowed_kpis(_arrivals(spark, d), "ts", ["event_type"], "value", "6 hours", late="2 days"), spark, "append-kpis")
    return show(_plain(out, "window_start").select("window_start", "event_type", "n", "total"), 2)


@query("R2_streamed_sessions", f"""
with {_in_time("ts + interval '6 hours'", '2 days')},
  g as (select *, coalesce(ts >= lag(ts) over w + interval '6 hours', true)::int as fresh from taken window w as (partition by user_id order by ts, event_id, part)),
  s as (select *, sum(fresh) over (partition by user_id order by ts, event_id, part rows unbounded preceding) as no from g)
select user_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, cast(count(*) as bigint) as n, {r('sum(value)', 2)} as total
from s, final group by user_id, no, mark having max(ts) + interval '6 hours' <= mark""")
def streamed_sessions(spark, d):
    out = sinks.run(st.sessions(_arrivals(spark, d), "ts", "user_id", "value", "6 hours", "2 days"), spark, "sessions")
    return show(_plain(out, "session_start", "session_end"), 2)


@query("R1_streamed_windowed_kpis", KPIS)
def streamed(spark, d):
    return _kpi_table(sinks.run(st.windowed_kpis(_events(spark, d), "ts", ["event_type"], "value", "6 hours"), spark, "kpis", "complete"))


@query("R2_sessions", f"""
with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval '6 hours' or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as no from g)
select user_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, cast(count(*) as bigint) as n, {r('sum(value)', 2)} as total from s group by user_id, no""")
def sessions(spark, d):
    return show(st.sessions(table(spark, d, "events"), "ts", "user_id", "value", "6 hours", key="event_id"), 2)


RULES = [{"column": "value", "rule_type": "max_value", "params": {"max": 50}},
         {"column": "event_type", "rule_type": "allowed_values", "params": {"allowed": ["view", "click"]}}]


@query("R3_rule_violations", """
with r as (select 1 as rule, 'value' as c, 'max_value' as k, ts, value > 50 as broken from events union all
  select 2, 'event_type', 'allowed_values', ts, event_type not in ('view', 'click') from events)
select cast(date_trunc('day', ts) as timestamp) as window_start, rule, c as "column", k as rule_type, cast(count(*) as bigint) as n,
  cast(count(*) filter (where broken) as bigint) as violations from r group by 1, 2, 3, 4""")
def violations(spark, d):
    return _plain(st.rule_violations(table(spark, d, "events"), "ts", RULES, "1 day"), "window_start")


@query("R3_streamed_rule_violations", """
select event_id from events where value > 50 or event_type not in ('view', 'click')""")
def streamed_violations(spark, d):
    return sinks.run(st.broken_rows(_events(spark, d), RULES).select("event_id"), spark, "rules")


@query("R4_dedup_events", "select distinct user_id, event_type from events")
def dedup(spark, d):
    return st.dedup_events(table(spark, d, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@query("R3_append_violations_with_late_rows", f"""
with {_in_time("date_trunc('day', ts) + interval 1 day", '2 days')},
  r as (select 1 as rule, ts, value > 50 as broken from taken union all select 2, ts, event_type not in ('view', 'click') from taken)
select cast(date_trunc('day', ts) as timestamp) as window_start, rule, cast(count(*) as bigint) as n, cast(count(*) filter (where broken) as bigint) as violations
from r, final group by 1, 2, mark having date_trunc('day', min(ts)) + interval 1 day <= mark""")
def append_violations(spark, d):
    out = sinks.run(st.rule_violations(_arrivals(spark, d), "ts", RULES, "1 day", "2 days"), spark, "append-rules")
    return _plain(out, "window_start").select("window_start", "rule", "n", "violations")


@query("R4_streamed_dedup", f"""with {_in_time("ts", '4 days')} select distinct event_id from taken""")
def streamed_dedup(spark, d):
    return sinks.run(st.dedup_events(_arrivals(spark, d), "ts", ["event_id"], "4 days").select("event_id"), spark, "dedup")


@query("R5_streamed_scores", f"select event_id, {r('2 + 3.0 * user_id', 3)} as prediction from events")
def scores(spark, d):
    """Scores of a model that was trained on an exact line, so its coefficients are known."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    line = table(spark, d, "events").where("user_id is not null").select("user_id", (2 + 3.0 * F.col("user_id")).alias("value"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["user_id"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="value", solver="normal")])
    path = sinks.new_folder(spark, "model")
    model.fit(line).save(path)
    return show(sinks.run(st.score_stream(_events(spark, d), path).select("event_id", "prediction"), spark, "scores"), 3)
