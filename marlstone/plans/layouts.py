"""Own sources, and tables laid out for their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import small
from ..sources import row_groups, scratch, table
from ..sources.layout import bucketed, by_folder
from ..streaming.drain import drain
from .registry import query


def _grouped(spark: SparkSession, d: str, rows: int) -> str:
    """The events in Parquet files of small row groups, in order of id; the given file is one group.

    A file has 100 groups at most, as whoever reads one of them reads the file's list of all; ranges grow in number with the rows.
    """
    path = scratch(spark, "row-groups")
    e = table(spark, d, "events")
    ranges = max(4, -(-e.count() // 1_000_000))
    e = e.repartitionByRange(ranges, "event_id").sortWithinPartitions("event_id")
    e.write.option("parquet.block.row.count.limit", rows).option("maxRecordsPerFile", 100 * rows).parquet(path)
    return path


@query("s5_python_source", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id >= 700 AND event_type = 'view'")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """A Python source: groups that their statistics rule out are not read, rows are filtered in it."""
    row_groups.register(spark)
    rows = spark.read.format(row_groups.NAME).load(_grouped(spark, d, 500)).where("event_id >= 700 AND event_type = 'view'")
    return rows.select("event_id", "user_id", "event_type", "value")


@query("s5_python_stream", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def s5_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same source as a stream, stopped and continued from its offsets when more files have come."""
    row_groups.register(spark)
    path, out, state = scratch(spark, "stream-in"), scratch(spark, "stream-out"), scratch(spark, "stream-state")
    e = table(spark, d, "events")
    for k, rows in enumerate((e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))):
        rows.write.parquet(f"{path}/{k}")
        result = drain(spark.readStream.format(row_groups.NAME).load(path), checkpoint=state, out=out)
    return result


@query("s6_bucketed_join", "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Orders and lines in the same buckets: the join itself shuffles nothing."""
    return bucketed_join(spark, d).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    orders = bucketed(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 8, "orders")
    lines = bucketed(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", 8, "lines")
    return orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


@query(
    "s7_dynamic_pruning",
    """WITH s AS (SELECT ts::DATE AS day, sum(value) AS sold FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT event_id, user_id, ts::DATE AS day FROM events WHERE ts::DATE IN (SELECT day FROM s WHERE sold > 1.2 * (SELECT avg(sold) FROM s))""",
)
def s7(spark: SparkSession, d: str) -> DataFrame:
    """Events of the days of the highest sales, from folders by day: only those days' folders are read."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    days = by_folder(e, "day")
    sales = e.where("event_type = 'purchase'").groupBy("day").agg(F.sum("value").alias("sold"))
    mean = sales.agg(F.avg("sold")).first()[0]
    busy = sales.where(F.col("sold") > F.lit(1.2) * F.lit(mean)).select("day")
    return days.join(small(busy), "day", "left_semi").select("event_id", "user_id", "day")
