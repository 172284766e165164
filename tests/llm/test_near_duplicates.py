from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import near_duplicates as nd
from tests.llm.frames import documents, empty, frame, prose, words


def expected(rows, t=0.8):
    texts = defaultdict(list)
    for r in rows:
        texts[r[1] or ""].append(r[0])
    names = list(texts)

    def shingles(text):
        w = words(text)
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(x) for x in names]
    root, links = list(range(len(names))), [0] * len(names)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * (1 + t) >= t * (len(sets[a]) + len(sets[b])) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, x in enumerate(names):
        ids = [i for i in texts[x] if i is not None] + ([least[find(k)]] if least.get(find(k)) is not None else [])
        least[find(k)] = min(ids) if ids else None
    return sorted(str((i, least[find(k)], links[k], len(texts[x]))) for k, x in enumerate(names) for i in texts[x])


def made_rows():
    r = random.Random(5)
    rows = documents()
    base = prose(50, 150).split()
    for i in range(60):  # one large group of near copies, some of them far apart
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"n{r.randrange(30)}"
        rows.append((1000 + i, " ".join(w), None, None, 0, "", 0, "", 0))
    for i in range(40):  # chains that drift away from their start
        w = prose(60, 100).split()
        w[: 2 * i] = [f"d{j}" for j in range(2 * i)]
        rows.append((2000 + i, " ".join(w), None, None, 0, "", 0, "", 0))
    return rows


@pytest.mark.parametrize("settings", [{}, {"VERIFY_BLOCK": 7, "BUCKET_BLOCK": 5, "FEW": 2, "BROADCAST_ROWS": -1}, {"FEW": 1}, {"VERIFY_BYTES": 20_000, "LEAST_BLOCK": 3}])
def test_against_all_pairs(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(nd, k, v)
    rows = made_rows()
    got = sorted(str((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"])) for r in nd.classes(frame(spark, rows)).collect())
    assert got == expected(rows)


def test_one_document_of_each_class_stays(spark):
    rows = made_rows()
    out = nd.keep_one(frame(spark, rows))
    assert out.columns == frame(spark).columns
    classes = Counter(r["class_id"] for r in nd.classes(frame(spark, rows)).select("root", "class_id").distinct().collect())
    assert set(classes) == {eval(x)[1] for x in expected(rows)}  # noqa: S307
    assert Counter(r["doc_id"] for r in out.collect()) == classes


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b", None, None, 0, "", 0, "", 0)] * 3 + [(None, "c d e f g h", None, None, 0, "", 0, "", 0)] * 2 + [(1, "z", None, None, 0, "", 0, "", 0)]
    assert sorted(str((r["doc_id"], r["text"])) for r in nd.keep_one(frame(spark, rows)).collect()) == ["(1, 'a b')", "(1, 'z')", "(None, 'c d e f g h')"]


def test_empty(spark):
    assert nd.classes(empty(spark)).collect() == [] and nd.keep_one(empty(spark)).collect() == []


def test_steps_bound_the_loss():
    """Pairs at the threshold are dropped at about the rate of the tolerance, which bounds the posterior, not this rate."""
    s = nd.Settings(tolerance=0.01)
    steps = nd.least_matches(s)
    r = np.random.default_rng(1)
    agree = r.random((200_000, s.hashes)) < s.threshold + (1 - s.threshold) / 256
    for n, least in steps:
        assert (agree[:, :n].sum(axis=1) < least).mean() < 0.03
    assert all(least > 0.55 * n for n, least in steps[2:])


def test_settings_may_differ(spark):
    rows = made_rows()
    got = sorted(str((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"])) for r in nd.classes(frame(spark, rows), nd.Settings(threshold=0.9)).collect())
    assert got == expected(rows, 0.9)


def test_slots_follow_the_data(spark, monkeypatch):
    """Three sizes: the texts of a slot stay about as many, their number grows."""
    most = []
    for n in (200, 800, 3200):
        rows = spark.range(n).select(F.col("id").alias("u1"), (F.col("id") % (n // 2)).alias("bucket"), F.lit(2).cast("long").alias("n"))
        tasks = nd.slots(n, 50, 4)
        dealt = nd._block_tasks(rows, "bucket", "n", nd.BUCKET_BLOCK, tasks)
        most.append(dealt.groupBy("slot").count().agg({"count": "max"}).first()[0])
        assert tasks == n // 50
    assert max(most) <= 120
    assert nd.slots(None, 50, 4) == 4 == nd.slots(10, 50, 4)
