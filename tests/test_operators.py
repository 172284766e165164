"""Edge cases that the tables do not hold: nulls, ties, empty input."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marlstone.functions.geometry import iou
from marlstone.operators.joins import asof_join, band_join, interval_join
from marlstone.operators.ranking import top_k, vote
from marlstone.sources import csv_round_trip, json_round_trip


def at(m):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def test_asof_takes_the_greatest_tie_and_keeps_the_unmatched(spark):
    left = spark.createDataFrame([("a", at(10), 1), ("a", at(1), 2), ("b", at(5), 3), (None, at(5), 4)], "k string, t timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(5), 1, "x"), ("a", at(5), 2, "y"), ("a", at(11), 3, "z")], "k string, t timestamp_ntz, n long, v string")
    got = {r["id"]: r["last"] for r in asof_join(left, right, "k", "t", "t", "n", {"v": "last"}).collect()}
    assert got == {1: "y", 2: None, 3: None, 4: None}


def test_asof_same_time_matches(spark):
    left = spark.createDataFrame([("a", at(5), 1)], "k string, t timestamp_ntz, id int")
    right = spark.createDataFrame([("a", at(5), 1, "x")], "k string, t timestamp_ntz, n long, v string")
    assert asof_join(left, right, "k", "t", "t", "n", {"v": "last"}).first()["last"] == "x"


def test_interval_join_has_both_ends(spark):
    left = spark.createDataFrame([("a", at(0), 1), ("a", at(59), 2)], "k string, t timestamp_ntz, l int")
    right = spark.createDataFrame([("a", at(60), 1), ("a", at(61), 2), ("a", at(0), 3)], "k string, u timestamp_ntz, r int")
    got = {(x["l"], x["r"]) for x in interval_join(left, right, "k", "t", "u", 3600).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2)}


def test_band_join_is_half_open(spark):
    points = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (-1.5,), (None,)], "x double")
    bands = spark.createDataFrame([(0.0, 2.0, "a"), (-2.0, 0.0, "b")], "lo double, hi double, n string")
    got = {(r["x"], r["n"]) for r in band_join(points, bands, "x", "lo", "hi", 0.7).collect()}
    assert got == {(0.0, "a"), (1.0, "a"), (-1.5, "b")}


def test_vote_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a")], "k int, v string")
    assert sorted(map(tuple, vote(df, ["k"], "v").collect())) == [(1, "a", 1), (2, "c", 2)]
    assert vote(df.limit(0), ["k"], "v").count() == 0


def test_top_k(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (1, 6), (2, 1)], "k int, v int")
    assert sorted((r["k"], r["v"]) for r in top_k(df, ["k"], [F.desc("v")], 2).collect()) == [(1, 6), (1, 7), (2, 1)]


def test_iou_of_empty_boxes(spark):
    df = spark.sql("SELECT named_struct('x1', 0D, 'y1', 0D, 'x2', 0D, 'y2', 0D) AS a, named_struct('x1', 0D, 'y1', 0D, 'x2', 1D, 'y2', 1D) AS b")
    assert df.select(iou(F.col("a"), F.col("a")), iou(F.col("a"), F.col("b")), iou(F.col("b"), F.col("b"))).first()[:] == (0.0, 0.0, 1.0)


def test_files_keep_nulls_and_quotes(spark):
    df = spark.createDataFrame([(1, 'say "hi", you', at(1)), (2, None, None), (3, "line\\n", at(2))], "i int, s string, t timestamp_ntz")
    assert sorted(map(tuple, csv_round_trip(df).collect())) == sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, json_round_trip(df).collect())) == sorted(map(tuple, df.collect()))


def test_sketches_prune_most_pairs(spark, sf_dir):
    from functools import reduce

    from pyspark.sql import DataFrame

    from marlstone.operators import vector_lsh
    from marlstone.operators.joins import in_blocks

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    b = e.select("vec_id", vector_lsh.sketches(F.col("embedding"), 64, 512, 42).alias("__b"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), vector_lsh.sketches(F.col("embedding"), 64, 512, 42).alias("__q"))
    most = vector_lsh.cut_off(b, q, 0.15, 1000)
    pairs = reduce(DataFrame.unionByName, [b.join(block, vector_lsh.differing(F.col("__q"), F.col("__b"), 8) <= most) for block in in_blocks(q, ["query_id"], F.lit(1), 3)])
    scored, everything = pairs.count(), b.count() * q.count()
    assert 0.05 * everything < scored < 0.2 * everything


def test_blocks_hold_all_queries(spark):
    from marlstone.operators.joins import in_blocks

    q = spark.range(100)
    blocks = in_blocks(q, ["id"], F.lit(8), 56)
    assert len(blocks) == 15 and sorted(r[0] for b in blocks for r in b.collect()) == list(range(100))
    assert in_blocks(spark.range(0), ["id"], F.lit(8))[0].collect() == []


def test_neighbours_of_repeated_queries_in_many_blocks(spark, sf_dir, monkeypatch, tmp_path):
    """Repeated rows, an id with many vectors, null vectors and blocks of a few rows: the rows are those of all pairs."""
    import numpy as np

    from marlstone.operators import joins
    from marlstone.plans import relational

    rng = np.random.default_rng(5)
    vector = lambda: [float(x) for x in rng.integers(-3, 4, 4)]
    rows = [(k, vector()) for k in range(120)] + [(50, vector()) for _ in range(60)] + [(100, [1.0, 2.0, 0.0, 1.0])] * 40 + [(7, [1.0, 0.0, 0.0, 0.0])] * 15
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = []
    for query in {i for i, _ in rows if i % 50 == 0}:
        pairs = sorted((-float(np.dot(p, v)), i) for j, p in rows if j == query for i, v in rows if i != query)[:10]
        want += [(query, i, r + 1, -s) for r, (s, i) in enumerate(pairs)]
    monkeypatch.setattr(joins.in_blocks, "__defaults__", (400,))
    got = [(r["query_id"], r["vec_id"], r["rank"], r["score"]) for r in relational.k2(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_blocks_are_of_bounded_bytes(spark):
    """An id with a third of all rows, wide vectors: blocks follow bytes, and hold each row once; equal rows stay k times at most."""
    from marlstone.functions.geometry import vector_bytes
    from marlstone.operators.joins import few_copies, in_blocks

    q = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("query_id"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("probe"))
    for most in (20_000, 60_000):
        blocks = in_blocks(q, ["query_id", "probe"], vector_bytes(F.col("probe")), most)
        sizes = [b.agg(F.sum(vector_bytes(F.col("probe")))).first()[0] or 0 for b in blocks]
        assert sum(sizes) == 3000 * 80 and max(sizes) < 1.5 * most
    copies = few_copies(spark.createDataFrame([(1, [1.0])] * 30 + [(1, [2.0])] * 2 + [(None, None)] * 12, "query_id long, probe array<double>"), 10)
    assert sorted((r["query_id"] or 0, r["count"]) for r in copies.groupBy("query_id", "probe").count().collect()) == [(0, 10), (1, 2), (1, 10)]


def test_vectors_that_do_not_fit(spark):
    from marlstone.operators.vector_lsh import lsh_top_k

    rows = [(k, [float(k % 7) - 3.0, 1.0, float(k % 5)]) for k in range(40)] + [(50, None), (51, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = lsh_top_k(df, df.where("vec_id IN (0, 50, 51)"), "vec_id", "embedding", 3, bits=64, share=1.0).collect()
    assert {r["query_id"] for r in got} == {0} and len(got) == 3 and not {r["vec_id"] for r in got} & {50, 51}
