from __future__ import annotations

import binascii

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import langid
from tests.llm.frames import documents, empty, frame, prose


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (4, 24)).astype(np.uint8), np.array([0, 1, 2, 1])
    net = langid.Network.new(["a", "b", "c"], d=3, f=2)
    for a in net.arrays():
        assert a.dtype == np.float32
    net.embed, net.dense, net.bias = (z.astype(np.float64) for z in (net.embed, net.dense, net.bias))
    net.filters, net.filter_bias = [z.astype(np.float64) for z in net.filters], [z.astype(np.float64) for z in net.filter_bias]
    _, gs = langid.gradients(net, x, y)
    for a, g in zip(net.arrays(), gs, strict=True):
        for k in r.integers(0, a.size, 6):
            old = a.flat[k]
            a.flat[k] = old + 1e-6
            up = langid.gradients(net, x, y)[0]
            a.flat[k] = old - 1e-6
            down = langid.gradients(net, x, y)[0]
            a.flat[k] = old
            assert (up - down) / 2e-6 == pytest.approx(g.flat[k], abs=1e-5)


def test_tables_are_the_network():
    r = np.random.default_rng(1)
    net = langid.Network.new(["a", "b"])
    x = r.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    e, pooled = net.embed[x], []
    for w, k, b in zip(langid.WIDTHS, net.filters, net.filter_bias, strict=True):
        columns = np.concatenate([e[:, j : x.shape[1] - w + 1 + j] for j in range(w)], axis=2)
        pooled.append((columns @ k + b).max(axis=1))
    p = langid.softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ net.dense + net.bias)
    assert np.allclose(langid.Scorer(net).windows(x), p, atol=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held", langid.held_out(F.col("doc_id")))
    assert all(r["held"] == (binascii.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs.collect())
    net = langid.fit(docs.where("NOT held").select("text", "lang"))
    rows = langid.predict(docs.where("held AND length(text) >= 100"), net, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_undetermined_and_empty(spark):
    net = langid.Network.new(["a", "b"])
    rows = langid.predict(frame(spark), net, keep=("text",)).collect()
    assert len(rows) == len(documents())
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (r["score"] == 0) == (not letters)
    assert langid.predict(empty(spark), net).collect() == []


def test_nothing_to_learn(spark):
    net = langid.fit(empty(spark))
    assert net.langs == [] and {r["lang_pred"] for r in langid.predict(frame(spark), net).collect()} == {"und"}


def test_every_window_counts():
    data = np.frombuffer(("A" * 700 + "b" * 10).encode(), np.uint8)
    x, text, length = langid.cut_windows(data, np.array([0, 700, 700, 710]))
    assert text.tolist() == [0, 0, 0, 2] and length.tolist() == [256, 256, 188, 10]
    assert set(x[0].tolist()) == {ord("a")} and set(x[3].tolist()) == {ord("b"), 0}


def test_capitals():
    for upper, lower in (("ÀÉÑÞ×", "àéñþ×"), ("CIÓN", "ción")):
        u, v = (np.frombuffer(t.encode(), np.uint8) for t in (upper, lower))
        assert (langid.cut_windows(u, np.array([0, len(u)]))[0] == langid.cut_windows(v, np.array([0, len(v)]))[0]).all()


def test_copies_do_not_thin_the_sample(spark):
    text = "concat('text number ', {} , ' of many words that fill a window')"
    copies = spark.range(4000).selectExpr("CASE WHEN id < 1000 THEN 'a' ELSE 'b' END AS lang", text.format("'one'") + " AS text")
    others = spark.range(520).selectExpr("CASE WHEN id < 500 THEN 'a' ELSE 'b' END AS lang", text.format("id") + " AS text")
    _, y, langs = langid.sample_windows(copies.unionByName(others), per_lang=10, per_doc=1)
    assert langs == ["a", "b"] and np.bincount(y, minlength=2).tolist() == [10, 10]


def test_every_labelled_language_is_learned(spark):
    """More languages than documents to spend, some with short texts only."""
    rows = [(f"l{k:03d}", f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * (30 if k % 2 else 3)) for k in range(300) for _ in range(3)]
    x, y, langs = langid.sample_windows(spark.createDataFrame(rows, "lang string, text string"), per_doc=1, in_all=150)
    assert langs == sorted({r[0] for r in rows}) and set(y.tolist()) == set(range(300)) and len(x) == 300


def test_predictions_against_the_definition(spark, sf_dir):
    """Each document's language and score from the layers themselves, a window and a place at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = documents()[:20] + [(500 + r["doc_id"], r["text"], None, None, 0, "", 0, "", 0) for r in docs.limit(15).collect()]
    got = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 3)) for r in langid.predict(frame(spark, rows), net).collect())

    def window(raw):
        x = np.zeros(langid.WINDOW, np.uint8)
        x[: len(raw)] = np.frombuffer(raw, np.uint8)
        e, h = net.embed[x].astype(np.float64), []
        for w, k, b in zip(langid.WIDTHS, net.filters, net.filter_bias, strict=True):
            h.append(np.max([e[i : i + w].reshape(-1) @ k + b for i in range(len(x) - w + 1)], axis=0))
        z = np.maximum(np.concatenate(h), 0) @ net.dense + net.bias
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def small(c):
        return c.lower() if c.isascii() or ("À" <= c <= "Þ" and c != "×") else c

    want = []
    for i, text, *_ in rows:
        raw = "".join(map(small, text or "")).encode()
        if not any(c.isalpha() for c in text or ""):
            want.append((str(i), "und", 0.0))
            continue
        parts = [raw[k : k + langid.WINDOW] for k in range(0, len(raw), langid.WINDOW)]
        p = sum(window(x) * len(x) for x in parts) / len(raw)
        want.append((str(i), net.langs[int(p.argmax())], round(float(p.max()), 3)))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 0.002


def test_labels_are_bounded(spark):
    """Ten thousand labels: those of the most different texts are learned, and every text gets one of them."""
    rows = [(k, f"{prose(k, 30)} {k}", f"x{k:05d}") for k in range(10_000)] + [(20_000 + k, prose(k % 40, 60) + str(k), "ab" if k % 2 else "cd") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, _, langs = langid.sample_windows(df.select("text", "lang"), per_lang=20, most_langs=5)
    assert langs == ["ab", "cd", "x00000", "x00001", "x00002"]
    net = langid.fit(df.select("text", "lang"), per_lang=20, most_langs=5)
    got = langid.predict(df.where("doc_id % 997 = 0 OR doc_id >= 20000"), net).collect()
    assert {r["lang_pred"] for r in got} <= set(langs)
