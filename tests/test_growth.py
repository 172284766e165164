"""What keeps queries from growing faster than their tables, and rows that larger or odder tables bring."""

from __future__ import annotations

import itertools
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marlstone.operators import graph, set_join, spatial
from marlstone.operators.set_join import similar_sets
from marlstone.plans import extensions
from marlstone.plans.catalog import ORACLE, QUERIES
from marlstone.plans.layouts import _grouped
from marlstone.sources import row_groups, table
from marlstone.streaming import idle
from tests.compare import same


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_polygons_are_tested_in_compiled_code_by_all_tasks(spark, sf_dir, monkeypatch):
    text = plan(QUERIES["j10_spatial"](spark, sf_dir))
    join = text[text.index("SortMergeJoin") :].split("\n")[0]
    assert "lambda" not in join and "Broadcast" not in text
    assert text.count("REPARTITION_BY_NUM") == 2
    r = random.Random(3)
    rings = [(k, [(r.uniform(0, 9), float(r.randint(0, 9))) for _ in range(n)]) for k, n in enumerate((3, 4, 9, 16, 5))]
    points = spark.createDataFrame([(k, r.uniform(0, 9), r.choice([r.uniform(0, 9), float(r.randint(0, 9))])) for k in range(400)], "point long, x double, y double")
    polygons = spark.createDataFrame(rings, "polygon long, ring array<struct<x:double,y:double>>")
    at = lambda: sorted(map(tuple, spatial.contains_join(points, polygons, 2.0).select("point", "polygon").collect()))
    compiled = at()
    monkeypatch.setattr(spatial, "FLAT_CORNERS", 8)
    assert compiled and compiled == at()


def test_arg_max_passes_over_events_without_value_or_id(spark, duck, tmp_path):
    rows = [(1, 1, None), (2, 2, 5.0), (3, 2, None), (4, 3, 1.0), (None, 3, 2.0), (5, 4, 7.0), (6, 4, float("nan")), (None, None, 1.0), (7, 5, -1.0), (8, 5, -2.0)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(path)
    duck.sql(f"CREATE TEMP VIEW odd AS SELECT * FROM '{path}/*.parquet'")
    same(QUERIES["a12_arg_max"](spark, str(tmp_path)), duck.sql(ORACLE["a12_arg_max"].replace("FROM events", "FROM odd")))


def test_distances_to_upper_case_are_those_of_levenshtein(spark, sf_dir, tmp_path):
    r = random.Random(5)
    docs = [(k, "\n".join("".join(r.choice("abAB aZz.1") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6)))) for k in range(200)]
    docs += [(500, None), (501, ""), (502, "é\nabc"), (503, "ab" * 200_000)]  # the last cost 10 ** 11 steps as a matrix
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["n_lines"], x["distance"]) for x in QUERIES["c3_line_distance"](spark, str(tmp_path)).collect()}
    assert got.pop(503) == (1, 400_000)
    lines = df.where("doc_id <> 503").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where("length(line) = octet_length(line)")
    want = lines.groupBy("doc_id").agg(F.count(F.lit(1)), F.sum(F.levenshtein("line", F.upper("line")))).collect()
    assert got == {x[0]: (x[1], x[2]) for x in want}


def test_a_type_has_one_sketch_and_a_pair_none(spark, sf_dir):
    text = plan(QUERIES["a3_approx_distinct_error"](spark, sf_dir))
    assert "approx_count_distinct" in text and not re.search(r"keys=\[event_type#\d+, user_id#\d+L?\], functions=\[[^\]]*approx", text)


def test_many_small_groups_are_few_partitions(spark, sf_dir):
    path = _grouped(spark, sf_dir, 1)
    row_groups.register(spark)
    schema = spark.read.format(row_groups.NAME).load(path).schema
    reader = row_groups.RowGroupReader(path, schema)
    parts = reader.partitions()
    ids = [i for p in parts for batch in reader.read(p) for i in batch.column("event_id").to_pylist()]
    assert sorted(ids) == [r[0] for r in table(spark, sf_dir, "events").select("event_id").orderBy("event_id").collect()]
    assert len(parts) < 100 < len(ids)
    assert max(pq.ParquetFile(p.path.removeprefix("file:")).num_row_groups for p in parts) <= 100  # each reader of a file reads the list of all its groups


def test_chunks_of_rows_make_the_bursts_of_single_rows(monkeypatch):
    """Any chunks give the bursts of gaps below the limit; a user has one timer, and what is closed leaves at once."""
    from pyspark.sql import Row

    monkeypatch.setattr(idle, "CHUNK", 7)

    class State(list):
        def get(self):
            return iter(list(self))

        def put(self, rows):
            self[:] = rows

    class Timers(set):
        registerTimer, deleteTimer = set.add, set.remove

    class Now:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 400

    r = random.Random(6)
    times = [r.randint(0, 900_000) for _ in range(60)]
    p, gap = idle.Bursts(10), 10_000
    p.handle, p.bursts = Timers(), State()
    for part in (times[:25], times[25:]):
        assert list(p.handleInputRows((1,), iter([Row(us=t) for t in part]), None)) == []
        assert len(p.handle) == 1
    want = []
    for t in sorted(times):
        want = [*want[:-1], (want[-1][0], t, want[-1][2] + 1)] if want and t - want[-1][1] < gap else [*want, (t, t, 1)]
    assert list(p.bursts) == want
    p.handle.clear()  # the timer has fired
    out = [(x["first"], x["last"], x["n"]) for x in p.handleExpiredTimer((1,), Now(), Now())]
    assert out == [b for b in want if p._closes(b[1]) <= 400] and list(p.bursts) == want[len(out) :] and len(out) > 1
    assert p.handle == {p._closes(want[len(out)][1])}


def test_all_pairs_of_like_sets_are_found_and_few_others_meet(spark, sf_dir):
    r = random.Random(7)
    sets = [r.sample([f"w{min(int(r.paretovariate(0.5)), 500)}" for _ in range(60)], r.randint(1, 40)) for _ in range(150)]
    sets += [[*s[: max(1, len(s) - r.randint(0, 3))], f"new{k}"] for k, s in enumerate(sets[:80])] + [["x"], ["x"], [], [f"y{k}" for k in range(10)], [f"y{k}" for k in range(7)]]
    sets = [sorted(set(s)) for s in sets]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>")
    for tenths in (7, 5, 10):
        want = {(i, j, len(set(a) & set(b)), len(set(a) | set(b))) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and 10 * len(set(a) & set(b)) >= tenths * len(set(a) | set(b))}
        rows = [tuple(x) for x in similar_sets(df, "id", "words", tenths).collect()]
        assert set(rows) == want and len(rows) == len(want) and want
    assert "MinHash" not in (p := plan(QUERIES["u2_minhash_lsh"](spark, sf_dir))) and "NestedLoop" not in p and "UDF" not in p  # tables of one hash let nearly all texts meet


def test_starts_go_together_through_a_graph(spark, monkeypatch):
    """Of 200 starts into one ring a round keeps a row for 64 starts and a node, not one for each pair; bits of the last start of a block have a sign."""
    edges = [(k, 1000) for k in range(200)] + [(1000 + k, 1000 + (k + 1) % 6) for k in range(6)]
    kept, rows = graph.kept, []

    def counted(df, name):
        out = kept(df, name)
        if name == "frontier":
            rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "kept", counted)
    e = spark.createDataFrame(edges, "src long, dst long")
    got = graph.reachable(e, spark.createDataFrame([(k,) for k in range(200)], "start long").coalesce(1))
    out = [(r["start"], r["node"], r["steps"]) for r in got.collect()]
    assert sorted(out) == sorted([(k, k, 0) for k in range(200)] + [(k, 1000 + j, 1 + j) for k in range(200) for j in range(6)])
    assert max(rows[1:]) <= 8


def test_vectors_meet_as_matrices_with_the_rows_of_all_pairs(spark, sf_dir, monkeypatch, tmp_path):
    """Slices and blocks of a few rows; copies, zeros, equal sums, odd vectors; and no fold runs over a pair."""
    from marlstone.operators import vector_blocks

    for name in ("k2_vector_topk", "u3_vector_lsh"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "NestedLoop" not in text and "zip_with" not in text and "CoGroup" in text
    monkeypatch.setattr(vector_blocks, "SLICE_BYTES", 600)
    monkeypatch.setattr(vector_blocks, "QUERY_BYTES", 200)
    monkeypatch.setattr(vector_blocks, "PAIRS", 40)
    r = random.Random(8)
    rows = [(k, [r.choice((0.1, 0.2, 0.3, -0.7)) for _ in range(5)]) for k in range(151)] + [(k, [0.3] * 5) for k in range(200, 260)] + [(300, [0.0] * 5), (350, [1.0] * 5), (350, [0.1, 0.7] * 2), (50, [0.3] * 5)] * 3
    odd = [(400, None), (401, [1.0]), (402, [float("nan")] * 5), (403, [None, 1.0, 1.0, 1.0, 1.0]), (450, [float("inf")] * 5), (500, [2.0] * 6), (None, [9.0] * 5)]
    for rest in ([], odd):
        df = spark.createDataFrame(rows + rest, "id long, v array<float>")
        asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        pairs = asked.join(df, F.col("id") != F.col("query_id")).select("query_id", "id", vector_blocks.dot(F.col("q"), F.col("v")).alias("score"))
        want = vector_blocks.top_k(pairs, ["query_id"], [F.desc("score"), F.col("id")], 10)
        at = lambda x: sorted(str(tuple(y)) for y in x.select("query_id", "id", "rank", "score").collect())
        assert at(vector_blocks.block_top_k(df, asked, 10)) == at(want)


def test_texts_are_ranked_without_shuffling_postings(spark, sf_dir, monkeypatch):
    """Small batches of scores, copies, null texts and too many terms for a task: rows are those of all scores by the index."""
    from marlstone.operators import text_ranking
    from marlstone.operators.text_index import TextIndex

    text = plan(QUERIES["r1_text_retrieval"](spark, sf_dir))
    assert "MapInArrow" in text and "Join" not in text and "term#" not in text[: text.index("MapInArrow")]
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(80)]
    texts = [" ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(80)], k=r.randint(1, 40))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (300, None), (301, ""), *[(k, texts[3]) for k in range(400, 430)], (500, "The THE été ÉTÉ")], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(0, texts[3]), (1, " ".join(vocabulary)), (2, "the été"), (3, None), (4, "unknown"), (5, "W1 w1 w70")], "item_id long, text string")
    at = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank", "score").collect()))
    want = at(TextIndex.build(docs, "doc_id", "text").search(items, "item_id", "text", 7))
    for name, value in (("CELLS", 50), ("ASKED", 3)):
        monkeypatch.setattr(text_ranking, name, value)
        assert at(text_ranking.ranked(docs, "doc_id", "text", items, "item_id", "text", 7)) == want
    monkeypatch.undo()
    assert at(text_ranking.ranked(docs.limit(0), "doc_id", "text", items, "item_id", "text", 7)) == []
    assert at(text_ranking.ranked(docs, "doc_id", "text", items.limit(0), "item_id", "text", 7)) == []


def test_users_of_a_group_share_state_and_timer(monkeypatch):
    """Calls to the state follow groups, not users; every user has the bursts that a state of its own gives."""
    from pyspark.sql import Row

    monkeypatch.setattr(idle, "CHUNK", 7)

    class State(list):
        calls = 0

        def get(self):
            self.calls += 1
            return iter(list(self))

        def put(self, rows):
            self.calls += 1
            self[:] = rows

    class Timers(set):
        registerTimer, deleteTimer = set.add, set.remove

    class Now:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 400

    r = random.Random(6)
    rows = [(r.choice([None, *range(20)]), r.randint(0, 900_000)) for _ in range(300)]
    p = idle.SharedBursts(10)
    p.handle, p.bursts = Timers(), State()
    for part in (rows[:125], rows[125:]):
        assert list(p.handleInputRows((1,), iter([Row(user_id=u, us=t) for u, t in part]), None)) == []
        assert len(p.handle) == 1
    assert p.bursts.calls == 4
    want = [(u, *b) for u in {u for u, _ in rows} for b in idle.merged([(t, t, 1) for v, t in rows if v == u], 10_000)]
    assert sorted(map(str, p.bursts)) == sorted(map(str, want))
    p.handle.clear()  # the timer has fired
    out = [(x["user_id"], x["first"], x["last"], x["n"]) for x in p.handleExpiredTimer((1,), Now(), Now())]
    rest = [b for b in want if p._closes(b[2]) > 400]
    assert sorted(map(str, out)) == sorted(str(b) for b in want if b not in rest) and sorted(map(str, p.bursts)) == sorted(map(str, rest)) and out
    assert p.handle == {min(p._closes(b[2]) for b in rest)}


def test_sets_that_share_a_rare_member_are_not_compared(spark, monkeypatch):
    """Whole sets travel only with pairs that share many of their rarest members; pairs just at the limit are among them, those just below are not returned."""
    r, tables = random.Random(11), {}
    kept = getattr(set_join, "kept", None)

    def noted(df, name):
        tables[name] = kept(df, name)
        return tables[name]

    monkeypatch.setattr(set_join, "kept", noted, raising=False)
    pairs = list(itertools.combinations(range(40), 2))
    sets = [{f"met{k}" for k, p in enumerate(pairs) if i in p} | {f"own{i}-{k}" for k in range(150)} for i in range(40)]  # each two share one rare member
    for n, m, common in ((170, 170, 140), (170, 170, 139), (140, 200, 140), (140, 201, 140), (340, 340, 280), (340, 340, 279)):
        whole = [f"s{len(sets)}-{k}" for k in range(n + m - common)]
        r.shuffle(whole)
        sets += [set(whole[:n]), set(whole[n - common :])]
    sets = [sorted(s) for s in sets]
    got = set_join.similar_sets(spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>"), "id", "words", 7).collect()
    want = {(i, j, len(set(a) & set(b)), len(set(a) | set(b))) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 10 * len(set(a) & set(b)) >= 7 * len(set(a) | set(b))}
    assert {tuple(x) for x in got} == want and len(got) == len(want) == 3
    assert tables["pairs"].count() <= 6 < len(pairs)


def test_near_copies_leave_texts_where_they_are_read(spark, tmp_path, monkeypatch):
    """Copies and rows that are repeated with their ids count once; no text is shuffled to find that out."""
    words = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:50])), (2, " ".join(words[:50])), (None, " ".join(words[:55])), (3, None), (4, " "), (5, " ".join(words[:30]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, kept = {}, extensions.kept
    monkeypatch.setattr(extensions, "kept", lambda df, name: (plans.update({name: plan(df)}), kept(df, name))[1])
    assert [tuple(x) for x in QUERIES["u2_minhash_lsh"](spark, str(tmp_path)).collect()] == [(0, 2, round(1 - 50 / 60, 6))]
    spark.createDataFrame([x for k, x in enumerate(rows) if k != 3], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["u2_minhash_lsh"](spark, str(tmp_path)).count() == 1
    assert "Exchange hashpartitioning" not in plans["bags"]


def test_a_round_of_the_traversal_follows_two_edges_and_writes_one_table(spark, monkeypatch):
    """600 starts lead into a path that ends in a ring; pairs are those of ``reachable``, of which each round writes two tables an edge."""
    kept, tables = graph.kept, []
    monkeypatch.setattr(graph, "kept", lambda df, name: (tables.append(name), kept(df, name))[1])
    edges = [(k, 1000 + k % 2) for k in range(600)] + [(1000 + k, 1001 + k) for k in range(12)] + [(1012, 1009), (1005, 1005), (None, 1), (1, None), (2000, 2001)]
    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(k,) for k in [*range(600), 2000, 3000, 5, None]], "start long").coalesce(1)
    got = [tuple(x) for x in graph.led_to(e, s).collect()]
    want = {(k, n) for k in range(600) for n in [k, *range(1000 + k % 2, 1013)]} | {(2000, 2000), (2000, 2001), (3000, 3000)}
    assert len(got) == len(want) and set(got) == want
    assert tables.count("reached") <= 2 + 14 // 2 and len(tables) == 3 + tables.count("reached")
    assert set(got) == {(x["start"], x["node"]) for x in graph.reachable(e, s).collect()}
    assert graph.led_to(e.limit(0), s).count() == 602 and graph.led_to(e, s.limit(0)).count() == 0
