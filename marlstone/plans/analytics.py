"""Evaluation, traversal, sketches, patterns and places over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detection import average_precision
from ..operators.graph import led_to
from ..operators.patterns import sequences
from ..operators.sketches import distinct_values, least_hashes, log_histogram, quantiles
from ..operators.spatial import contains_join
from ..sources import kept, table
from .registry import query

# Boxes: each vector gives a true box and two found ones near it; eight vectors are an image.

_TRUE_BOX = {"x1": "40 * e[{0}]", "y1": "40 * e[{1}]", "x2": "40 * e[{0}] + 20 + 100 * abs(e[{2}])", "y2": "40 * e[{1}] + 20 + 100 * abs(e[{3}])"}
_MOVED = {"x1": "x1 + {m} * e[{0}]", "y1": "y1 + {m} * e[{1}]", "x2": "x2 + {m} * e[{2}]", "y2": "y2 + {m} * e[{3}]"}


def _box(fields: dict[str, str], first: int, m: int = 0) -> str:
    return ", ".join(f"{x.format(*range(first, first + 4), m=m)} AS {k}" for k, x in fields.items())


_LEVELS = (0.5, 0.75)


@query(
    "c10_detection_ap",
    f"""WITH RECURSIVE v AS (SELECT vec_id, vec_id // 8 AS image, label % 3 AS kind, embedding::DOUBLE[] AS e FROM embeddings),
    t AS (SELECT vec_id AS truth_id, image, kind, e, {_box(_TRUE_BOX, 1)} FROM v),
    f AS (SELECT 2 * truth_id AS found_id, image, kind, round(0.5 + e[9], 1) AS score, {_box(_MOVED, 5, 30)} FROM t
          UNION ALL SELECT 2 * truth_id + 1, image, kind, round(0.5 + e[14], 1), {_box(_MOVED, 10, 60)} FROM t),
    i AS (SELECT f.found_id, t.truth_id, greatest(0, least(f.x2, t.x2) - greatest(f.x1, t.x1)) * greatest(0, least(f.y2, t.y2) - greatest(f.y1, t.y1)) AS meet,
                 greatest(0, f.x2 - f.x1) * greatest(0, f.y2 - f.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS areas FROM f JOIN t USING (image, kind)),
    o AS (SELECT found_id, truth_id, meet / (areas - meet) AS overlap FROM i),
    l AS (SELECT unnest({list(_LEVELS)})::DOUBLE AS least),
    c AS (SELECT least, found_id, list(truth_id ORDER BY overlap DESC, truth_id) AS wanted FROM o, l WHERE overlap >= least GROUP BY least, found_id),
    r AS (SELECT image, kind, found_id, row_number() OVER (PARTITION BY image, kind ORDER BY score DESC, found_id) AS k FROM f),
    m AS (SELECT least, image, kind, 0::BIGINT AS k, 0::BIGINT AS found_id, []::BIGINT[] AS taken, NULL::BIGINT AS got FROM l, (SELECT DISTINCT image, kind FROM r)
          UNION ALL
          SELECT least, image, kind, k, found_id, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END, got FROM (
            SELECT m.least, m.image, m.kind, r.k, r.found_id, m.taken, list_filter(coalesce(c.wanted, []::BIGINT[]), lambda x: NOT list_contains(m.taken, x))[1] AS got
            FROM m JOIN r ON r.image = m.image AND r.kind = m.kind AND r.k = m.k + 1 LEFT JOIN c ON c.least = m.least AND c.found_id = r.found_id)),
    n AS (SELECT kind, count(*) AS n_truth FROM t GROUP BY kind),
    p AS (SELECT m.least, f.kind, (m.got IS NOT NULL)::INT AS hit, sum((m.got IS NOT NULL)::INT) OVER w AS hits, row_number() OVER w AS place FROM m JOIN f USING (found_id) WHERE m.k > 0 WINDOW w AS (PARTITION BY m.least, f.kind ORDER BY f.score DESC, f.found_id)),
    b AS (SELECT least, kind, i, max(hits / place) AS best FROM p JOIN n USING (kind), range(101) x(i) WHERE hits * 100 >= i * n_truth GROUP BY least, kind, i)
    SELECT least, kind, n_truth, n_found, n_matched, round(coalesce(ap, 0), 6) AS ap FROM n JOIN (SELECT least, kind, count(*) AS n_found, sum(hit)::BIGINT AS n_matched FROM p GROUP BY least, kind) USING (kind)
    LEFT JOIN (SELECT least, kind, sum(best) / 101 AS ap FROM b GROUP BY least, kind) USING (least, kind)""",
)
def c10_ap(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of found boxes by kind, at two overlaps."""
    v = table(spark, d, "embeddings").selectExpr("vec_id", "vec_id DIV 8 AS image", "label % 3 AS kind", "CAST(embedding AS array<double>) AS e")
    boxed = v.selectExpr("vec_id", "image", "kind", "e", *[f"{x.format(*range(4))} AS {k}" for k, x in _TRUE_BOX.items()])
    box = F.struct("x1", "y1", "x2", "y2").alias("box")
    moved = lambda first, m: [f"{w.format(*range(first, first + 4), m=m)} AS {k}" for k, w in _MOVED.items()]
    one = boxed.selectExpr("2 * vec_id AS found_id", "image", "kind", "round(0.5D + e[8], 1) AS score", *moved(4, 30))
    two = boxed.selectExpr("2 * vec_id + 1 AS found_id", "image", "kind", "round(0.5D + e[13], 1) AS score", *moved(9, 60))
    truth = boxed.select("image", "kind", F.col("vec_id").alias("truth_id"), box)
    found = one.unionByName(two).select("image", "kind", "found_id", "score", box)
    at = [average_precision(truth, found, least).withColumn("least", F.lit(least)) for least in _LEVELS]
    return at[0].unionByName(at[1]).select("least", "kind", "n_truth", "n_found", "n_matched", F.round("ap", 6).alias("ap"))


@query(
    "o4_traversal",
    """WITH RECURSIVE e AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_orderpriority = '1-URGENT'),
    r AS (SELECT c_custkey AS start, c_custkey AS node FROM customer WHERE c_acctbal > 9900 UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node)
    SELECT start, node FROM r""",
)
def o4_traversal(spark: SparkSession, d: str) -> DataFrame:
    """Customers that an urgent order leads to by the next order's customer, from those of the highest balances, over any number of orders; the graph has cycles."""
    o = table(spark, d, "orders")
    first = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1).alias("k"))
    edges = first.join(o.select(F.col("o_custkey").alias("dst"), F.col("o_orderkey").alias("k")), "k").select("src", "dst")
    starts = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("start"))
    return led_to(edges, starts)


_K = 64


@query(
    "a3_mergeable_distinct",
    f"""WITH h AS (SELECT DISTINCT event_type, date_trunc('week', ts)::TIMESTAMP AS week, ('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT AS h FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY event_type, week ORDER BY h) AS r FROM h)
    SELECT event_type, week, CASE WHEN count(*) < {_K} THEN count(*)::DOUBLE ELSE round({_K - 1} * {float(1 << 60)!r}::DOUBLE / max(h), 3) END AS n, count(*) < {_K} AS exact FROM s WHERE r <= {_K} GROUP BY event_type, week""",
)
def a3_mergeable(spark: SparkSession, d: str) -> DataFrame:
    """Different users by type and week, from sketches that are stored by type and day."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = kept(least_hashes(e, ["event_type", "day"], F.col("user_id"), _K), "daily-distinct")
    weekly = daily.withColumn("week", F.date_trunc("week", F.col("day").cast("timestamp")).cast("timestamp_ntz"))
    return distinct_values(weekly, ["event_type", "week"], _K)


_ERROR = 0.01


@query(
    "a5_mergeable_quantile",
    f"""WITH e AS (SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week, value FROM events), b AS (SELECT ln((1 + {_ERROR}::DOUBLE) / (1 - {_ERROR}::DOUBLE)) AS base),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type, week ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type, week) AS n FROM e),
    q AS (SELECT unnest([0.5, 0.95])::DOUBLE AS q),
    v AS (SELECT event_type, week, q, n, (1 - {_ERROR}::DOUBLE) * exp(ceil(ln(value) / base) * base) AS value FROM r, q, b WHERE r = greatest(1, ceil(q * n)::BIGINT))
    SELECT v.event_type, v.week, q, v.n, round(v.value, 6) AS value, count(*) FILTER (e.value < 0.9899 * v.value) AS n_below, count(*) FILTER (e.value <= 1.0101 * v.value) AS n_upto
    FROM v JOIN e ON e.event_type = v.event_type AND e.week = v.week GROUP BY ALL""",
)
def a5_mergeable(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile by type and week from stored daily sketches, and the exact ranks of what they give: the wanted one lies between."""
    e = table(spark, d, "events").select("event_type", "ts", "value")
    daily = kept(log_histogram(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], F.col("value"), _ERROR), "daily-quantiles")
    week = lambda c: F.date_trunc("week", F.col(c).cast("timestamp")).cast("timestamp_ntz").alias("week")
    weekly = daily.select("event_type", week("day"), "bucket", "n")
    at = [quantiles(weekly, ["event_type", "week"], q, _ERROR).withColumn("q", F.lit(q)) for q in (0.5, 0.95)]
    given = at[0].unionByName(at[1]).withColumnRenamed("value", "given")
    rows = e.select("event_type", week("ts"), "value").join(given, ["event_type", "week"])
    below, upto = F.count(F.when(F.col("value") < 0.9899 * F.col("given"), 1)), F.count(F.when(F.col("value") <= 1.0101 * F.col("given"), 1))
    return rows.groupBy("event_type", "week", "q", "n", F.round("given", 6).alias("value")).agg(below.alias("n_below"), upto.alias("n_upto"))


@query(
    "w5_sequences",
    """WITH c AS (SELECT * FROM events WHERE event_type = 'click'), v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
    a AS (SELECT c.user_id, c.event_id AS id_1, c.ts AS began, v.event_id AS id_2, v.ts FROM c ASOF JOIN v ON c.user_id = v.user_id AND c.ts < v.ts)
    SELECT a.user_id, id_1, id_2, p.event_id AS id_3 FROM a ASOF JOIN p ON a.user_id = p.user_id AND a.ts < p.ts WHERE p.ts <= began + INTERVAL 2 DAY""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    """A click, the next view and the next purchase of a user within two days."""
    return sequences(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", ["click", "view", "purchase"], 2 * 86_400)


#: Corners of a polygon with a notch, around a supplier's place.
_CORNERS = ((-2, -1), (2, -2), (1, 0), (3, 2), (0, 1), (-2, 2))


@query(
    "j10_spatial",
    f"""WITH p AS (SELECT c_custkey, c_acctbal / 100 AS x, (c_custkey * 37 % 1000) / 10 AS y FROM customer),
    s AS (SELECT s_suppkey, s_acctbal / 100 AS x, (s_suppkey * 53 % 1000) / 10 AS y, 1 + s_suppkey % 4 AS size FROM supplier),
    k AS (SELECT s_suppkey, x + size * a AS ax, y + size * b AS ay, x + size * c AS bx, y + size * d AS cy FROM s,
          (VALUES {", ".join(f"({a}, {b}, {c}, {e})" for (a, b), (c, e) in zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True))}) v(a, b, c, d))
    SELECT c_custkey, s_suppkey FROM p, k WHERE (ay > y) <> (cy > y) AND x < (bx - ax) * (y - ay) / nullif(cy - ay, 0) + ax GROUP BY c_custkey, s_suppkey HAVING count(*) % 2 = 1""",
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the polygons of suppliers; places come from balances and keys, as no table holds any."""
    points = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") * 37 % 1000 / 10).alias("y"))
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("px"), (F.col("s_suppkey") * 53 % 1000 / 10).alias("py"), (1 + F.col("s_suppkey") % 4).alias("size"))
    ring = F.array(*[F.struct((F.col("px") + F.col("size") * a).alias("x"), (F.col("py") + F.col("size") * b).alias("y")) for a, b in _CORNERS])
    return contains_join(points, s.select("s_suppkey", ring.alias("ring")), 8.0).select("c_custkey", "s_suppkey")
