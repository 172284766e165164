"""Operators of evaluation, traversal, sketches, patterns and places on small awkward frames, against plain loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators.detection import average_precision, match
from marlstone.operators.graph import reachable
from marlstone.operators.patterns import sequences
from marlstone.operators.running import running_sums
from marlstone.operators.sketches import distinct_values, least_hashes, log_histogram, quantiles
from marlstone.operators.spatial import contains_join

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    return both / (area(a) + area(b) - both) if area(a) + area(b) - both > 0 else 0.0


def greedy(truth, found, least):
    taken, out = set(), {}
    for image, kind, i, box, _ in sorted(found, key=lambda f: (-f[4], f[2])):
        free = [(-o, t[2]) for t in truth if t[:2] == (image, kind) and t[2] not in taken and (o := overlap(box, t[3])) >= least]
        if free:
            taken.add(min(free)[1])
            out[i] = min(free)[1]
    return out


def boxes(seed):
    r = random.Random(seed)
    at = lambda: r.choice([0.0, 1.0, 2.0, 3.0])
    box = lambda: (x := at(), y := at(), x + r.choice([0.0, 2.0, 3.0]), y + r.choice([2.0, 3.0]))
    truth = [(r.randint(0, 3), r.choice("ab"), k, box()) for k in range(40)]
    found = [(r.randint(0, 4), r.choice("abc"), k, box(), r.choice([0.1, 0.5, 0.5, 0.9])) for k in range(90)]
    return truth, found


def frames(spark, truth, found):
    t = spark.createDataFrame([(*x, "clash") for x in truth], f"image long, kind string, truth_id long, box {BOX}, score string").repartition(3)
    return t, spark.createDataFrame(found, f"image long, kind string, found_id long, box {BOX}, score double").repartition(3)


@pytest.mark.parametrize("least", [0.3, 0.6])
def test_matching_is_the_greedy_one(spark, least):
    truth, found = boxes(3)
    t, f = frames(spark, truth, found)
    assert {r["found_id"]: r["truth_id"] for r in match(t, f, least).collect()} == greedy(truth, found, least)


def test_average_precision(spark):
    truth, found = boxes(5)
    t, f = frames(spark, truth, found)
    hits, want = greedy(truth, found, 0.4), {}
    for kind in {x[1] for x in truth}:
        n, tp, curve = sum(x[1] == kind for x in truth), 0, []
        for place, x in enumerate(sorted((x for x in found if x[1] == kind), key=lambda x: (-x[4], x[2])), 1):
            tp += x[2] in hits
            curve.append((tp / n, tp / place))
        want[kind] = sum(max((p for r, p in curve if r * 100 >= k - 1e-9), default=0) for k in range(101)) / 101
    got = {r["kind"]: r["ap"] for r in average_precision(t, f, 0.4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    nothing = average_precision(t, f.limit(0), 0.4).collect()
    assert all((r["n_found"], r["n_matched"], r["ap"]) == (0, 0, 0.0) for r in nothing) and len(nothing) == len(want)
    assert average_precision(t.limit(0), f, 0.4).count() == 0


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), k, r.randint(0, 5)) for k in range(500)]
    got = running_sums(spark.createDataFrame(rows, "g string, k long, v long").repartition(7), ["g"], [F.desc("k")], {"total": F.col("v")}).where("g IS NOT NULL").collect()
    place, total, want = defaultdict(int), defaultdict(int), {}
    for g, k, v in sorted(rows, key=lambda x: -x[1]):
        place[g] += 1
        total[g] += v
        want[k] = (g, place[g], total[g])
    assert {x["k"]: (x["g"], x["place"], x["total"]) for x in got} == {k: v for k, v in want.items() if v[0] is not None}


def test_reachable(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(80)] + [(k, k + 1) for k in range(100, 130)] + [(130, 100), (7, 7), (None, 1), (2, None)]
    starts = [0, 5, 100, 999, None, 5]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            near[a].add(b)
    want = {}
    for s in {0, 5, 100, 999}:
        level, steps = {s}, 0
        while level:
            want |= {(s, n): steps for n in level}
            level = {m for n in level for m in near[n] if (s, m) not in want}
            steps += 1
    e = spark.createDataFrame(edges, "src long, dst long")
    s = spark.createDataFrame([(x,) for x in starts], "start long")
    rows = reachable(e, s).collect()
    assert {(x["start"], x["node"]): x["steps"] for x in rows} == want and len(rows) == len(want)
    assert {(x["start"], x["node"]) for x in reachable(e, s, 2).collect()} == {k for k, v in want.items() if v <= 2}
    assert reachable(e.limit(0), s).count() == 4 and reachable(e, s.limit(0)).count() == 0


def test_distinct_sketches_merge(spark, duck):
    rows = [(k % 3, k % 7, None if k % 50 == 0 else f"v{k * 37 % 5000 if k % 3 else k % 20}") for k in range(20_000)]
    df = spark.createDataFrame(rows, "kind long, day long, v string")
    cells = least_hashes(df, ["kind", "day"], F.col("v"), 256)
    assert cells.groupBy("kind", "day").count().agg({"count": "max"}).first()[0] <= 256
    merged = sorted(map(tuple, distinct_values(cells, ["kind"], 256).collect()))
    assert merged == sorted(map(tuple, distinct_values(least_hashes(df, ["kind"], F.col("v"), 256), ["kind"], 256).collect()))
    exact = {k: len({v for a, _, v in rows if a == k and v is not None}) for k in range(3)}
    assert all(n == exact[k] if whole else abs(n - exact[k]) <= 4 / math.sqrt(256) * exact[k] for k, n, whole in merged) and merged[0][2]


def test_quantile_sketches_merge(spark):
    r = random.Random(9)
    rows = [(k % 2, k % 5, r.choice([None, float("nan"), 0.0]) if k % 97 == 0 else r.choice([-1, 1]) * 10 ** r.uniform(-5, 6)) for k in range(6000)]
    df = spark.createDataFrame(rows, "kind long, day long, v double")
    daily = log_histogram(df, ["kind", "day"], F.col("v"), 0.02)
    for q in (0.0, 0.1, 0.5, 0.999, 1.0):
        for kind, n, value in quantiles(daily, ["kind"], q, 0.02).collect():
            values = sorted(v for k, _, v in rows if k == kind and v is not None and not math.isnan(v))
            true = values[max(1, math.ceil(q * len(values))) - 1]
            assert n == len(values) and abs(value - true) <= 0.0201 * abs(true)
        assert sorted(map(tuple, quantiles(daily, ["kind"], q, 0.02).collect())) == sorted(map(tuple, quantiles(log_histogram(df, ["kind"], F.col("v"), 0.02), ["kind"], q, 0.02).collect()))
    assert log_histogram(df.limit(0), ["kind"], F.col("v"), 0.02).count() == 0


def test_builtin_sketches_merge_over_ranges(spark, sf_dir, duck):
    """Spark's own sketches by day: merged ones are the direct ones, and SQL finds the exact numbers near what they return."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    daily = e.groupBy("event_type", "day").agg(F.hll_sketch_agg("user_id", 12).alias("s"))
    got = daily.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"))
    direct = e.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).alias("users"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, direct.collect()))
    returned = got.toPandas()  # noqa: F841  read by the SQL
    duck.register("returned", returned)
    bad = duck.sql("SELECT * FROM returned JOIN (SELECT event_type, count(DISTINCT user_id) AS exact FROM events GROUP BY 1) USING (event_type) WHERE abs(users - exact) > greatest(1, 0.05 * exact)")
    assert bad.fetchall() == []


def test_sequences(spark):
    r = random.Random(6)
    t0 = datetime(2024, 1, 1)
    rows = [(r.choice([1, 2, 3, None]), None if k % 40 == 0 else t0 + timedelta(minutes=r.randint(0, 300)), k, r.choice("abcx")) for k in range(400)]
    steps, want = ["a", "b", "a", "c"], set()
    by = defaultdict(list)
    for u, t, k, kind in rows:
        if u is not None and t is not None:
            by[u].append((t, k, kind))
    for u, events in by.items():
        events.sort()
        for i, (t, k, kind) in enumerate(events):
            ids, at = [k], i
            if kind != steps[0]:
                continue
            for step in steps[1:]:
                at = next((j for j in range(at + 1, len(events)) if events[j][2] == step), None)
                if at is None:
                    break
                ids.append(events[at][1])
            if at is not None and events[at][0] <= t + timedelta(minutes=30):
                want.add((u, *ids))
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, kind string").repartition(3)
    got = sequences(df, "user_id", "ts", "event_id", "kind", steps, 1800)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = list(map(tuple, got.collect()))
    assert set(rows) == want and len(rows) == len(want) > 20
    assert sequences(df.limit(0), "user_id", "ts", "event_id", "kind", steps, 1800).count() == 0


def in_ring(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [0.7, 50.0])
def test_points_in_polygons(spark, cell):
    r = random.Random(8)
    points = [(k, r.choice([None, *map(float, range(-6, 7)), r.uniform(-6, 6)]), float(r.randint(-6, 6))) for k in range(300)]
    rings = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(4, 0), (6, 0), (6, 4), (4, 4)], [(-5, -5), (5, -5), (0, 0), (5, 5), (-5, 5)], [(1, 1), (2, 2)], [], None]
    p = spark.createDataFrame(points, "point long, x double, y double")
    q = spark.createDataFrame([(k, None if g is None else [tuple(map(float, c)) for c in g]) for k, g in enumerate(rings)], "polygon long, ring array<struct<x:double,y:double>>")
    got = contains_join(p, q, cell)
    want = {(i, k) for i, x, y in points if x is not None for k, g in enumerate(rings) if g and len(g) > 2 and in_ring(x, y, g)}
    rows = [(r["point"], r["polygon"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
