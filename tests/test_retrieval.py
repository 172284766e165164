"""Indexes: results, what they touch, awkward rows, plans."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from marlstone.operators import vector_index
from marlstone.operators.text_index import TextIndex
from marlstone.operators.vector_index import VectorIndex
from marlstone.plans.catalog import ORACLE, QUERIES

VECTORS = "vec_id long, embedding array<float>, cell int, slice int, q string"

def clustered(n: int, groups: int, dimension: int = 16, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    return (r.standard_normal((groups, dimension))[r.integers(0, groups, n)] * 3 + 0.3 * r.standard_normal((n, dimension))).astype(np.float32)

def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else list(map(float, v)), 1, 2, "clash") for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], VECTORS).repartition(3)

def brute(x, queries, k):
    out = {}
    for i in queries:
        score = x.astype(np.float64) @ x[i].astype(np.float64)
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-score[j], j))[:k]
        out |= {(i, j): r + 1 for r, j in enumerate(order)}
    return out

def test_certified_search_is_exact_in_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "SLICE_ROWS", 37)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 11)
    x = np.concatenate((clustered(380, 9), clustered(20, 1), clustered(5, 1)[:1].repeat(5, 0)))
    docs = frame(spark, x)
    index = VectorIndex.build(docs, "vec_id", "embedding", cells=9)
    assert index.slices.max() > 1 and index.lists.count() == len(x)
    got = index.search(docs.where("vec_id % 7 = 0"), "vec_id", "embedding", 6, probes=1, rerank=6, exact=True)
    assert {(r["query_id"], r["id"]): r["rank"] for r in got.collect()} == brute(x, range(0, len(x), 7), 6)

def test_probing_finds_nine_in_ten_and_touches_a_fifth(spark):
    x = clustered(3000, 40)
    docs = frame(spark, x)
    index = VectorIndex.build(docs, "vec_id", "embedding")
    queries = docs.where("vec_id % 50 = 0")
    probes = max(1, len(index.slices) // 10)
    want = set(brute(x, range(0, len(x), 50), 10))
    got = {(r["query_id"], r["id"]) for r in index.search(queries, "vec_id", "embedding", 10, probes).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert probes / len(index.slices) < 0.2
    fetched = index.candidates(queries, "vec_id", "embedding", 10, probes, 100, True, True)[0].count()
    assert fetched < 0.2 * len(x) * queries.count()

def test_awkward_vectors(spark):
    x = [[1.0, 0.0, 2.0], None, [], [1.0], [0.0, 0.0, 0.0], [float("nan"), 1.0, 1.0], [1.0, 0.0, 2.0], [-1.0, 5.0, 0.5]]
    docs = frame(spark, x)
    index = VectorIndex.build(docs, "vec_id", "embedding")
    assert {r["id"] for r in index.lists.collect()} == {0, 4, 6, 7}
    got = [(r["query_id"], r["id"], r["rank"], round(r["score"], 6)) for r in index.search(docs, "vec_id", "embedding", 2, probes=1, exact=True).collect()]
    assert sorted(got) == [(0, 4, 2, 0.0), (0, 6, 1, 5.0), (4, 0, 1, 0.0), (4, 6, 2, 0.0), (6, 0, 1, 5.0), (6, 4, 2, 0.0), (7, 0, 1, 0.0), (7, 4, 2, 0.0)]
    none = VectorIndex.build(docs.limit(0), "vec_id", "embedding")
    assert none.search(docs, "vec_id", "embedding", 2, probes=1, exact=True).count() == 0

def test_vector_plans_join_by_equality(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = VectorIndex.build(e, "vec_id", "embedding").search(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, probes=4, exact=True)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in text and "NestedLoop" not in text and "Cartesian" not in text

def bm25(docs, queries, k):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = {i: Counter(split(t)) for i, t in docs}
    mean = sum(b.total() for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for q, text in queries:
        points = Counter()
        for w in set(split(text)):
            idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
            for i, b in bags.items():
                if b[w]:
                    points[i] += math.floor(1e6 * idf * (b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean))) + 0.5)
        for r, (i, p) in enumerate(sorted(points.items(), key=lambda x: (-x[1], x[0]))[:k]):
            out[q, i] = r + 1, round(p / 1e6, 6)
    return out

@pytest.mark.parametrize("k", [1, 3, 50])
def test_text_search_against_all_scores(spark, k):
    r = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(200)]
    rank = 1 / np.arange(1, 201)
    texts = [" ".join(r.choice(vocabulary, r.integers(1, 60), p=rank / rank.sum())) for _ in range(300)]
    docs = [*enumerate(texts), (300, None), (301, ""), (302, texts[5]), (303, "The THE the été ÉTÉ"), (304, "...")]
    queries = [(0, texts[5]), (1, " ".join(vocabulary)), (2, "the été"), (3, None), (4, "unknown"), (5, "W1 w1 w150"), (6, texts[9] + " " + texts[10])]
    frame = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, term string, block long").repartition(3)
    asked = spark.createDataFrame([(*x, 1.0) for x in queries], "item_id long, text string, impact double")
    index = TextIndex.build(frame, "doc_id", "text")
    got = {(x["query_id"], x["doc_id"]): (x["rank"], round(x["score"], 6)) for x in index.search(asked, "item_id", "text", k).collect()}
    assert got == bm25(docs, queries, k)
    if k == 1:
        read, every = index.postings_read(asked, "item_id", "text", k)
        assert read < every
    assert TextIndex.build(frame.limit(0), "doc_id", "text").search(asked, "item_id", "text", k).count() == 0


def test_texts_without_an_id_are_asked_and_found(spark, tmp_path):
    import duckdb

    docs = [(1, "red apple tree"), (2, "green apple"), (None, "red tree tree"), (7, None), (9, "green apple")]
    items = [(1, "apple"), (None, "tree green"), (None, "red"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    want = sorted(con.sql(ORACLE["r1_text_retrieval"]).fetchall(), key=key)
    got = sorted((tuple(x) for x in QUERIES["r1_text_retrieval"](spark, str(tmp_path)).collect()), key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want] and any(x[0] is None for x in got) and any(x[1] is None for x in got)
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))
