"""Timers, late rows, the Python source and table layouts: state, restarts, plans."""

from __future__ import annotations

from datetime import datetime, timedelta

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marlstone.plans.layouts import _grouped, bucketed_join
from marlstone.plans.streams import t8
from marlstone.sources import row_groups, scratch, table
from marlstone.sources.layout import by_folder
from marlstone.streaming.drain import drain
from marlstone.streaming.idle import bursts
from marlstone.streaming.late import Split
from marlstone.streaming.stateful import rocks_db

T0 = datetime(2024, 1, 1)


def test_state_of_bursts_is_bounded(spark, tmp_path):
    """Ten runs over ten days: each closes the bursts of the days before, so the rows of the state do not grow."""
    kept = []
    with rocks_db(spark):
        for day in range(4):
            rows = [(u, T0 + timedelta(days=day, hours=h, minutes=m)) for u in range(3) for h in (1, 9, 20) for m in (0, 5, 30)]
            spark.createDataFrame([*rows, (1, None)], "user_id long, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
            s = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
            q = bursts(s, 3_600_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            kept.append(max((p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:] if p["stateOperators"]), default=0))
    assert max(kept) <= kept[0] * 1.5 + 3
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = [(u, T0 + timedelta(days=d, hours=h), T0 + timedelta(days=d, hours=h, minutes=30), 3) for u in range(3) for d in range(4) for h in (1, 9, 20)]
    assert got == sorted(w for w in want if not (w[1].day == 4 and w[1].hour == 20))


def test_rows_in_any_order_make_the_same_bursts(spark, tmp_path):
    minutes = [0, 100, 50, 55, 200, 130, 75, 1000]  # 0-50-55-75-100-130 is one burst of gaps up to an hour
    spark.createDataFrame([(1, T0 + timedelta(minutes=m)) for m in minutes], "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    with rocks_db(spark):
        s = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "10 minutes")
        got = sorted((r["began"], r["ended"], r["n"]) for r in drain(bursts(s, 3_600_000)).collect())
    assert got == [(T0, T0 + timedelta(minutes=130), 6), (T0 + timedelta(minutes=200), T0 + timedelta(minutes=200), 1)]


def test_both_outputs_are_the_input(spark, sf_dir):
    out = t8(spark, sf_dir)
    ids = {r[0] for r in table(spark, sf_dir, "events").select("event_id").collect()}
    assert {r["event_id"] for r in out.collect()} == ids
    assert out.where("NOT late").groupBy("event_id").count().where("count > 1").count() == 0


def test_split_goes_on_after_a_stop_and_takes_rows_without_time(spark, tmp_path):
    split = Split(key="k", time="ts", seconds=60, folder=f"{tmp_path}/split")
    schema = "k long, ts timestamp"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    batches = [[(1, T0), (2, T0 + timedelta(seconds=90)), (2, T0 + timedelta(seconds=91)), (3, None)], [(4, T0), (1, T0 + timedelta(seconds=40)), (5, T0 + timedelta(seconds=35))], []]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        once, late = split.run(stream())
    assert sorted(r["k"] for r in once.collect()) == [1, 2, 5] and sorted(r["k"] for r in late.collect()) == [3, 4]
    again, _ = Split(**split.__dict__).run(stream())
    assert again.count() == 3


def test_source_reads_only_groups_that_may_match(spark, sf_dir):
    path = _grouped(spark, sf_dir, 50)
    row_groups.register(spark)
    schema = spark.read.format(row_groups.NAME).load(path).schema
    assert {f.name: f.dataType for f in schema} == {f.name: f.dataType for f in table(spark, sf_dir, "events").schema}
    reader = row_groups.RowGroupReader(path, schema)
    every = len(reader.partitions())
    left = list(reader.pushFilters([row_groups.GreaterThanOrEqual(("event_id",), 900), row_groups.EqualTo(("event_type",), "view")]))
    groups = reader.partitions()
    assert every >= 10 and 0 < len(groups) < every / 3 and left == []
    assert all(g.path.endswith(".parquet") and g.group < pq.ParquetFile(g.path.removeprefix("file:")).num_row_groups for g in groups)
    got = spark.read.format(row_groups.NAME).load(path).where("event_id BETWEEN 10 AND 20 AND value > 1e9 OR user_id IS NULL")
    assert got.count() == 0


def test_source_takes_each_group_once(spark, sf_dir):
    path = _grouped(spark, sf_dir, 100)
    row_groups.register(spark)
    reader = row_groups.RowGroupStreamReader(path, spark.read.format(row_groups.NAME).load(path).schema, 3)
    reader.given = 0
    at, ids = reader.initialOffset(), []
    while (end := reader.latestOffset()) != at:
        for part in reader.partitions(at, end):
            ids += [i for batch in reader.read(part) for i in batch.column("event_id").to_pylist()]
        at = end
    assert sorted(ids) == [r[0] for r in table(spark, sf_dir, "events").select("event_id").orderBy("event_id").collect()]
    out, state = scratch(spark, "o"), scratch(spark, "s")
    for _ in range(2):  # a second run finds nothing new
        rows = drain(spark.readStream.format(row_groups.NAME).load(path), checkpoint=state, out=out)
    assert rows.count() == len(ids)


def test_bucketed_join_has_no_exchange(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = bucketed_join(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_join_prunes_folders(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    days = by_folder(e, "day")
    few = e.where("event_id < 20").select("day").distinct()
    text = days.join(F.broadcast(few), "day", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text.lower()
