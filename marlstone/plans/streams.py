"""Event-time queries, on batches and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch, table
from ..streaming.drain import drain, events, file_stream
from ..streaming.idle import bursts
from ..streaming.late import Split
from ..streaming.stateful import milestones, rocks_db
from .registry import query


def _start(c: str = "window.start"):
    return F.col(c).cast("timestamp_ntz").alias("start")


def _n():
    return F.count(F.lit(1)).alias("n")


@query("s4_stream_source", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'")
def s4(spark: SparkSession, d: str) -> DataFrame:
    return drain(file_stream(spark, d, "events.parquet").where("event_type <> 'view'").select("event_id", "user_id", "event_type"))


@query("t1_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour")).agg(_n(), F.round(F.sum("value"), 2).alias("total")).select(_start(), "n", "total")


@query(
    "t2_sliding",
    """SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * i AS start, event_type, count(*) AS n FROM events, range(4) t(i) GROUP BY 1, 2""",
)
def t2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes"), "event_type").agg(_n()).select(_start(), "event_type", "n")


@query(
    "t3_session",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def t3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(_n()).select("user_id", _start("w.start"), "n")


@query(
    "t4_watermark",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2
    HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""",
)
def t4(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has closed."""
    e = events(spark, d).withWatermark("ts", "1 hour")
    return drain(e.groupBy(F.window("ts", "1 hour"), "event_type").agg(_n()).select(_start(), "event_type", "n"))


@query(
    "t5_late_data",
    """WITH e AS (SELECT *, event_id % 10 = 0 AS late, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM events),
    mark AS (SELECT date_trunc('millisecond', max(ts) FILTER (NOT late)) - INTERVAL 1 HOUR AS first, date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS last FROM e)
    SELECT start, count(*) AS n FROM e, mark WHERE (NOT late OR start + INTERVAL 1 HOUR > first) AND start + INTERVAL 1 HOUR <= last GROUP BY start""",
)
def t5(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event comes in a second run, after the watermark of the first: late rows of closed windows are dropped."""
    e = table(spark, d, "events")
    into, out, state = scratch(spark, "late-in"), scratch(spark, "late-out"), scratch(spark, "late-state")
    for late in (False, True):
        e.where((F.col("event_id") % 10 == 0) == F.lit(late)).write.mode("append").parquet(into)
        s = spark.readStream.schema(e.schema).parquet(into).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
        result = drain(s.groupBy(F.window("ts", "1 hour")).agg(_n()).select(_start(), "n"), checkpoint=state, out=out)
    return result


@query("t6_stateful", "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 20 = 0")
def t6(spark: SparkSession, d: str) -> DataFrame:
    with rocks_db(spark):
        return drain(milestones(events(spark, d), 20))


@query(
    "t7_stream_stream",
    """SELECT b.event_id AS purchase_id, a.event_id AS click_id, b.user_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
)
def t7(spark: SparkSession, d: str) -> DataFrame:
    a = events(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("click_ts")).withWatermark("click_ts", "1 hour")
    b = events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("buy_ts")).withWatermark("buy_ts", "1 hour")
    near = (F.col("u") == F.col("user_id")) & (F.col("buy_ts") >= F.col("click_ts")) & (F.col("buy_ts") <= F.col("click_ts") + F.expr("INTERVAL 2 HOURS"))
    return drain(a.join(b, near).select("purchase_id", "click_id", "user_id"))


@query("t7_stream_static", "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def t7_static(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return drain(events(spark, d).join(customers, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", "c_mktsegment"))


@query(
    "t6_idle_timers",
    """WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events))
    SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, s
    HAVING max(ts) + INTERVAL 2 HOUR < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""",
)
def t6_idle(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a user's events, two hours apart, that timers have closed; the events come in three runs, each with a third of the days."""
    e = table(spark, d, "events")
    into, out, state = scratch(spark, "idle-in"), scratch(spark, "idle-out"), scratch(spark, "idle-state")
    with rocks_db(spark):
        for part in range(3):
            e.where(F.floor((F.dayofmonth("ts") - 1) / 11) == part).select("user_id", "ts").write.mode("append").parquet(into)
            s = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(into).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
            result = drain(bursts(s, 2 * 3_600_000), checkpoint=state, out=out)
    return result.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query(
    "t8_late_side_output",
    """WITH e AS (SELECT *, event_id % 10 = 0 AS second FROM events), line AS (SELECT max(ts) FILTER (NOT second) - INTERVAL 1 DAY AS line FROM e)
    SELECT event_id, user_id, ts, second AND ts < line AS late FROM e, line
    UNION ALL SELECT event_id, user_id, ts, TRUE FROM e, line WHERE event_id % 10 = 1 AND ts < line""",
)
def t8(spark: SparkSession, d: str) -> DataFrame:
    """Two runs: every tenth event comes in the second, with every eleventh of the first again; all rows are in time, repeated or late.

    Repeats in time are dropped, late rows, repeats among them, are kept beside.
    """
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    into, split = scratch(spark, "split-in"), Split.new(spark, "event_id", "ts", 86_400)
    for rows in (e.where("event_id % 10 <> 0"), e.where("event_id % 10 IN (0, 1)")):
        rows.write.mode("append").parquet(into)
        s = spark.readStream.schema(e.schema).parquet(into).withColumn("ts", F.col("ts").cast("timestamp"))
        once, late = split.run(s)
    both = once.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
