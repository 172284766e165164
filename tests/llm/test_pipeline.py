from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from marlstone.llm import langid, pieces
from tests.llm import test_line_dedup, test_near_duplicates
from tests.llm.frames import empty, frame, words


def test_stages_on_awkward_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, frame(spark).select(*columns), sf_dir)
        out.collect()
        assert k == len(cp.STAGES) - 1 or out.columns == columns
        assert stage(spark, empty(spark).select(*columns), sf_dir).collect() == []


CLASHES = ("score", "lang_pred", "letters", "copies", "n_tokens", "lines", "n_lines", "n_removed", "held_out", "node", "label", "u1", "place", "share", "a.b")


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    docs = frame(spark).select(*base).withColumns({c: F.concat_ws("-", F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        for r in out.select(*[F.col(f"`{c}`") for c in ("doc_id", *CLASHES)]).collect():
            assert all(r[c] == "-".join([c, *([str(r["doc_id"])] if r["doc_id"] is not None else [])]) for c in CLASHES)
    assert cp.encode(spark, docs, sf_dir).count() == docs.count()


def test_mixing_and_pieces_stages_against_the_operators(spark, sf_dir):
    """Rows drawn are those of a loop over the permutation; ids are those of the encoder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = Counter(r["doc_id"] for r in cp.mix(spark, docs, sf_dir).collect())
    assert drawn == {i: n for i, n in expected_copies([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], cp.MIX).items() if n}
    encoder = pieces.Encoder()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in cp.encode(spark, docs, sf_dir).collect():
        ids = encoder.ids(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["round_trip"]) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)


def expected_copies(rows, target):
    """Exponent by plain bisection, then each source's documents in order of md5 until its budget is used up."""
    size = {i: len(words(t)) for i, _, t in rows}
    tokens = Counter()
    for i, s, _ in rows:
        tokens[s] += size[i]
    total = sum(tokens.values())
    shares = [n / total for n in tokens.values() if n]

    def weights(a):
        z = sum(p**a for p in shares)
        return [p**a / z for p in shares]

    def bisect(holds):  # the largest exponent with it, holds being true up to there
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return 1.0 if holds(1.0) else low

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a))
    a = bisect(lambda x: entropy(x) >= target.evenness * math.log(len(shares)) - 1e-12)
    least = min(shares)
    allowed = lambda x: least**x / sum(p**x for p in shares) <= target.repeats * least * (1 + 1e-12)
    a = round(max(a, 0.0 if allowed(0.0) else bisect(lambda x: not allowed(x))), 6)
    out = {}
    for s, n in tokens.items():
        want = math.floor((n / total) ** a / sum(p**a for p in shares) * total + 1e-6)
        used = 0
        for i in sorted((i for i, x, _ in rows if x == s), key=lambda i: hashlib.md5(f"0:{s}:{i}".encode()).hexdigest()):
            used += size[i]
            out[i] = want // n + (used <= want - want // n * n)
    return out


def test_language_stage_keeps_labelled_prose(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in cp.language_id(spark, docs, sf_dir).collect()}
    assert {r["doc_id"] for r in docs.collect() if len(set(r["text"].split())) >= 20} <= kept
    assert kept == {r["doc_id"] for r in langid.predict(docs, langid.fit(docs.where(~langid.held_out(docs["doc_id"])))).where("lang_pred <> 'und' AND score >= 0.35").collect()}


def test_line_stage_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.lines(spark, docs, sf_dir).collect()}
    assert got == {i: (t, len(t)) for i, t, _, _ in test_line_dedup.expected(rows)}


def test_near_stage_keeps_one_of_each_class(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in cp.near(spark, docs, sf_dir).collect()} == {eval(x)[1] for x in test_near_duplicates.expected(rows)}  # noqa: S307


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert rows and all(r["round_trip"] for r in rows)
