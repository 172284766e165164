"""Batch queries: scans, filters, joins, aggregates, windows, sets and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import band, iou, norm
from ..operators.joins import asof_join, band_join, interval_join, null_equal, small
from ..operators.ranking import top_k, vote
from ..operators.vector_blocks import block_top_k
from ..sources import csv_round_trip, json_round_trip, partitioned_sink, table
from .registry import query


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# Scans and sinks


@query("s1_parquet_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R'")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 49 AND l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


@query("s2_csv", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def s2_csv(spark: SparkSession, d: str) -> DataFrame:
    return csv_round_trip(table(spark, d, "events"))


@query("s2_json", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def s2_json(spark: SparkSession, d: str) -> DataFrame:
    return json_round_trip(table(spark, d, "events"))


@query("s3_partitioned_sink", "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_type = 'purchase'")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return partitioned_sink(table(spark, d, "events"), "event_type").where("event_type = 'purchase'")


# Projection and filter


@query("f1_projection", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (_revenue() * (1 + F.col("l_tax"))).alias("charge"))


@query(
    "f2_predicates",
    """SELECT p_partkey, p_name, p_brand, p_size FROM part
    WHERE p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#33') AND p_name LIKE '%e%' AND NOT regexp_matches(p_type, '^SMALL')""",
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    keep = F.col("p_size").between(5, 30) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#21", "Brand#33") & F.col("p_name").like("%e%") & ~F.col("p_type").rlike("^SMALL")
    return p.where(keep).select("p_partkey", "p_name", "p_brand", "p_size")


@query(
    "f3_nulls",
    """SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.toxic IS NULL AS unlabelled, l.quality IS NOT DISTINCT FROM l.toxic AS same
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def f3(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").isNull().alias("unlabelled"), null_equal(F.col("quality"), F.col("toxic")).alias("same"))


@query("f4_banding", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'middle' ELSE 'high' END AS band FROM customer")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", band(F.col("c_acctbal"), [(0, "debt"), (2500, "low"), (7500, "middle")], "high").alias("band"))


# Joins


@query(
    "j1_inner_multiway",
    """SELECT r_name, n_name, c_mktsegment, count(*) AS n, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18, 4))::DOUBLE AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name, c_mktsegment""",
)
def j1(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    # Lines shrink to a row per order before they meet the rest.
    per_order = lines.groupBy("l_orderkey").agg(_count(), F.sum(_revenue().cast("decimal(18, 4)")).cast("decimal(24, 4)").alias("revenue"))
    j = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.sum("n").alias("n"), F.sum("revenue").cast("double").alias("revenue"))


@query("j2_left_outer", "SELECT d.doc_id, d.lang, l.quality::VARCHAR AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j2_left(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id", "left")


@query("j2_right_outer", "SELECT d.doc_id, d.source, l.toxic::VARCHAR AS toxic FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
def j2_right(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", "toxic").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "right").select("doc_id", "source", F.col("toxic").cast("string").alias("toxic"))


@query("j2_full_outer", "SELECT coalesce(c.c_custkey, s.s_suppkey) AS k, c_name, s_name FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 3")
def j2_full(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey") * 3, "full").select(F.coalesce("c_custkey", "s_suppkey").alias("k"), "c_name", "s_name")


@query("j3_left_semi", "SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j3(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, d, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderpriority")


@query("j4_left_anti", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j5_broadcast", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def j5(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(small(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(small(places), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(_count())


@query("j6_cross", "SELECT r_name, n_name, r_regionkey = n_regionkey AS inside FROM region CROSS JOIN nation")
def j6_cross(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("inside"))


@query(
    "j6_range",
    """SELECT p.p_partkey, b.band FROM part p JOIN (SELECT i AS band, 900.0 + 40 * i AS low, 900.0 + 40 * i + 60 AS high FROM range(30) t(i)) b
    ON p.p_retailprice >= b.low AND p.p_retailprice < b.high""",
)
def j6_range(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.range(30).select(F.col("id").alias("band"), (900.0 + 40 * F.col("id")).alias("low"), (960.0 + 40 * F.col("id")).alias("high"))
    return band_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "low", "high", 60.0).select("p_partkey", "band")


@query(
    "j7_asof",
    """SELECT a.event_id, a.user_id, a.ts, b.event_id::VARCHAR AS view_id, b.ts AS view_ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def j7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    buys, views = e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'")
    out = asof_join(buys, views, "user_id", "ts", "ts", "event_id", {"event_id": "view_id", "ts": "view_ts"})
    return out.withColumn("view_id", F.col("view_id").cast("string"))


@query(
    "j8_interval",
    """SELECT a.event_id AS click_id, b.event_id AS error_id, a.user_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'error'""",
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    return interval_join(clicks, errors, "user_id", "click_ts", "error_ts", 3600).select("click_id", "error_id", "user_id")


@query("j9_lateral", "SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t")
def j9(spark: SparkSession, d: str) -> DataFrame:
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    inner = nation.where(F.col("n_regionkey") == F.col("r_regionkey").outer()).orderBy("n_name").limit(2).select("n_name")
    return region.lateralJoin(inner).select("r_name", "n_name")


# Aggregation


@query(
    "a1_aggregates",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
    FROM lineitem GROUP BY ALL""",
)
def a1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        _count(), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest")
    )


@query("a2_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY event_type")
def a2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("days"))


@query("a3_approx_distinct")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("a3_approx_distinct_error", "SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS near FROM events GROUP BY event_type")
def a3_error(spark: SparkSession, d: str) -> DataFrame:
    """The exact number, and whether the approximate one is within three times its stated error."""
    approx = F.approx_count_distinct("user_id", 0.02)
    exact = F.count("user_id")
    near = F.abs(approx - exact) <= F.greatest(F.lit(1.0), exact * 0.06)
    # Different pairs first: beside a distinct count Spark would keep a sketch for each pair, not one for each type. Repeats do not change a sketch.
    pairs = table(spark, d, "events").select("event_type", "user_id").distinct()
    return pairs.groupBy("event_type").agg(exact.alias("users"), near.alias("near"))


@query("a4_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("a5_approx_percentile")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.percentile_approx("value", 0.5, 10_000).alias("median"))


@query("a5_approx_percentile_error", "SELECT event_type, count(*) AS n, TRUE AS near FROM events GROUP BY event_type")
def a5_error(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each type, and whether the rank of the approximate median is within the stated error of the middle."""
    e = table(spark, d, "events").select("event_type", "value")
    median = e.groupBy("event_type").agg(F.percentile_approx("value", 0.5, 100).alias("median"))
    below = F.count(F.when(F.col("value") < F.col("median"), 1))
    upto = F.count(F.when(F.col("value") <= F.col("median"), 1))
    n = F.count(F.lit(1))
    near = (below <= n * 0.51 + 1) & (upto >= n * 0.49 - 1)
    return e.join(F.broadcast(median), "event_type").groupBy("event_type").agg(n.alias("n"), near.alias("near"))


_SETS = """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty
    FROM lineitem GROUP BY """


def _sets(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "level", "n", F.round("qty", 2).alias("qty"))


def _set_measures():
    return F.grouping_id().alias("level"), _count(), F.sum("l_quantity").alias("qty")


@query("a6_rollup", _SETS + "ROLLUP (l_returnflag, l_linestatus)")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return _sets(table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(*_set_measures()))


@query("a7_cube", _SETS + "CUBE (l_returnflag, l_linestatus)")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return _sets(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(*_set_measures()))


@query("a8_grouping_sets", _SETS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def a8(spark: SparkSession, d: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return _sets(table(spark, d, "lineitem").groupingSets([(flag,), (status,), ()], flag, status).agg(*_set_measures()))


@query(
    "a9_pivot",
    "SELECT conv_id, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY conv_id",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a10_ordered_strings", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.expr("listagg(role, '>') WITHIN GROUP (ORDER BY turn)").alias("roles"))


@query(
    "a11_vote",
    """SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return vote(table(spark, d, "events"), ["user_id"], "event_type")


@query("a12_arg_max", "SELECT user_id, arg_max(event_id, value) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """The event of the greatest value, the least id of equal ones. As in SQL an event without a value or id is never it."""
    known = F.when(F.col("value").isNotNull() & F.col("event_id").isNotNull(), F.struct("value", -F.col("event_id")))
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", known).alias("event_id"), F.max("value").alias("value"))


@query("a13_exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def a13(spark: SparkSession, d: str) -> DataFrame:
    # Grouped by digest: texts themselves need not be shuffled.
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    return t.groupBy("h", "n").agg(F.min("doc_id").alias("doc_id"), _count("copies")).select("doc_id", "copies")


# Windows


@query(
    "w1_ranks",
    """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY date_trunc('month', o_orderdate))""".replace("row_number() OVER w", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
)
def w1(spark: SparkSession, d: str) -> DataFrame:
    by = W.partitionBy("o_custkey")
    exact, month = by.orderBy("o_orderdate", "o_orderkey"), by.orderBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    long = lambda c, w, n: c.over(w).cast("long").alias(n)
    return table(spark, d, "orders").select("o_orderkey", long(F.row_number(), exact, "rn"), long(F.rank(), month, "rk"), long(F.dense_rank(), month, "dr"), long(F.ntile(4), exact, "quarter"))


@query(
    "w2_offsets",
    """SELECT event_id, lag(event_type) OVER w AS before, lead(value, 2, 0.0) OVER w AS after, first_value(event_id) OVER w AS first, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def w2(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, d, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before"), F.lead("value", 2, 0.0).over(w).alias("after"), F.first("event_id").over(w).alias("first"), F.last("event_id").over(whole).alias("last")
    )


@query("w3_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)), 6).alias("moving"))


@query("w4_time_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events")
def w4(spark: SparkSession, d: str) -> DataFrame:
    frame = "count(1) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS last_day"
    return table(spark, d, "events").selectExpr("event_id", frame)


# Order, top k, sets


@query("k1_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    "k2_vector_topk",
    """SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (
    SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
    FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10""",
)
def k2(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector against all others, slices and blocks as matrices. A meeting keeps ten rows a query, so pairs are not shuffled."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = block_top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), q, 10)
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("o1_union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def o1_all(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return c.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")).unionByName(s.select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")))


@query("o1_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def o1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def _keys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))


_PAIR = "SELECT o_custkey AS k FROM orders {} SELECT c_custkey FROM customer WHERE c_acctbal > 0"


@query("o2_intersect", _PAIR.format("INTERSECT"))
def o2(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.intersect(b)


@query("o2_intersect_all", _PAIR.format("INTERSECT ALL"))
def o2_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.intersectAll(b)


@query("o3_except", _PAIR.format("EXCEPT"))
def o3(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.subtract(b)


@query("o3_except_all", _PAIR.format("EXCEPT ALL"))
def o3_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _keys(spark, d)
    return a.exceptAll(b)


@query("o4_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
def o4(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")


# Scalars


@query("c1_strings", "SELECT doc_id, lower(source) AS lo, reverse(lang) AS back, md5(trim(text)) AS digest FROM documents")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower("source").alias("lo"), F.reverse("lang").alias("back"), F.md5(F.trim("text")).alias("digest"))


@query("c2_split", "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS pieces, string_split(text, ' ')[1] AS head FROM documents")
def c2(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("pieces"), parts[0].alias("head"))


@query(
    "c3_case_distance",
    "SELECT p_partkey, upper(p_name) AS up, levenshtein(p_brand, 'Brand#11')::BIGINT AS distance FROM part WHERE length(p_name) = strlen(p_name)",
)
def c3(spark: SparkSession, d: str) -> DataFrame:
    ascii_only = F.length("p_name") == F.octet_length("p_name")
    return table(spark, d, "part").where(ascii_only).select("p_partkey", F.upper("p_name").alias("up"), F.levenshtein("p_brand", F.lit("Brand#11")).cast("long").alias("distance"))


@query("c3_case_distance_documents")
def c3_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same over the whole texts of all documents: distances up to 64, -1 beyond, so the cost is that of a text's length and not of its square; no SQL, as engines differ beyond ASCII."""
    distance = F.levenshtein("text", F.upper("text"), 64)
    return table(spark, d, "documents").select("doc_id", F.upper("text").alias("up"), distance.cast("long").alias("distance"))


@query(
    "c3_line_distance",
    """SELECT doc_id, count(*) AS n_lines, sum(levenshtein(line, upper(line)))::BIGINT AS distance FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE length(line) = strlen(line) GROUP BY doc_id""",
)
def c3_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whole distances of all lines that are ASCII to their upper case, by document.

    Such a distance is the number of letters a-z, so its cost is a line's length and not the square: replacing each
    of them is enough, and no alignment is cheaper, as it leaves as many characters unmatched as the line is long less
    its matches, and upper case holds no a-z to match one.
    """
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length("line") == F.octet_length("line"))
    changed = F.length("line") - F.length(F.translate("line", "abcdefghijklmnopqrstuvwxyz", ""))
    return lines.groupBy("doc_id").agg(_count("n_lines"), F.sum(changed).cast("long").alias("distance"))


@query("c4_regex_url", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


@query("c5_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, dayofweek(o_orderdate) + 1 AS dow FROM orders")
def c5(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    long = lambda c, n: c.cast("long").alias(n)
    return table(spark, d, "orders").select("o_orderkey", long(F.year(t), "y"), long(F.month(t), "m"), F.date_trunc("month", t.cast("timestamp")).cast("timestamp_ntz").alias("month_start"), long(F.dayofweek(t), "dow"))


@query("c6_json", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("c7_variant", "SELECT (props::JSON ->> '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")).groupBy("k").agg(_count())


@query(
    "c8_arrays",
    """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 5) AS l1, embedding[3] AS third FROM embeddings""",
)
def c8(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    l1 = F.aggregate(F.transform(v, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"), F.round(l1, 5).alias("l1"), v[2].alias("third"))


@query(
    "c8_explode_map",
    "SELECT vec_id, i - 1 AS pos, embedding[i] AS x FROM embeddings, range(1, 65) t(i) WHERE embedding[i] > 0.3",
)
def c8_map(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    m = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("long")), "embedding")
    return e.select("vec_id", F.explode(F.map_filter(m, lambda _, x: x > F.lit(0.3))).alias("pos", "x"))


@query("c9_math", "SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_extendedprice), 4) AS root, round(ln(l_extendedprice), 4) AS log, round(l_extendedprice, 1) AS half_up, round_even(l_quantity / 2, 0)::BIGINT AS half_even, floor(l_extendedprice / 7)::BIGINT AS sevenths FROM lineitem")
def c9(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sqrt(p), 4).alias("root"), F.round(F.ln(p), 4).alias("log"), F.round(p, 1).alias("half_up"), F.bround(F.col("l_quantity") / 2, 0).cast("long").alias("half_even"), F.floor(p / 7).cast("long").alias("sevenths"))


_BOXES = [(0, 0.0, 0.0, 4.0, 4.0), (1, 2.0, 2.0, 6.0, 6.0), (2, 4.0, 0.0, 8.0, 4.0), (3, 1.0, 1.0, 1.0, 5.0), (4, 0.0, 0.0, 4.0, 3.0)]


@query(
    "c10_box_iou",
    f"""WITH b(id, x1, y1, x2, y2) AS (VALUES {", ".join(f"({i}::BIGINT, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for i, a, b, c, e in _BOXES)}),
    p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM b a JOIN b ON a.id < b.id)
    SELECT a, b, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) AS iou FROM p""",
)
def c10(spark: SparkSession, d: str) -> DataFrame:
    boxes = spark.createDataFrame(_BOXES, "id long, x1 double, y1 double, x2 double, y2 double").select("id", F.struct("x1", "y1", "x2", "y2").alias("box"))
    a, b = boxes.select(F.col("id").alias("a"), F.col("box").alias("p")), boxes.select(F.col("id").alias("b"), F.col("box").alias("q"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(iou(F.col("p"), F.col("q")), 6).alias("iou"))


@query("c11_vector_norm", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def c11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"))
