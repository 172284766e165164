from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import functions as F

from marlstone.llm import fingerprints as fp
from tests.llm.frames import SCHEMA, documents, empty, frame


def canonical(text):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(t.split())


def test_canonical_is_that_of_python(spark):
    texts = ["", None, "  A b\n\nC ", "Straße ﬁ Å é", "ÀÉ x　y", "ABC", "İI", "日本 ｱ", "a\x85b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fp.canonical(F.col("t"))).collect()] == [canonical(t) for t in texts]


def test_equal_just_where_canonical_texts_are(spark):
    rows = fp.fingerprint(frame(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["fingerprint"], set()).add(canonical(r["text"]))
    assert len(rows) == len(documents()) and all(len(v) == 1 for v in by.values())
    assert len(by) == len({canonical(d[1]) for d in documents()})
    assert set(rows[0].asDict()) == {c.split()[0] for c in SCHEMA.split(", ")} | {"fingerprint"}


def test_bytes_are_compared_inside_a_bucket(spark):
    rows = fp.fingerprint(frame(spark), bucket_of=lambda h1, h2: F.lit("same")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["fingerprint"], set()).add(canonical(r["text"]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({canonical(d[1]) for d in documents()})


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(following))))
    return sorted(out)


def test_edit_likeness(spark, monkeypatch):
    for per_cell in (2, 1024):
        original = fp.with_next
        monkeypatch.setattr(fp, "with_next", lambda docs, payload, f=original, n=per_cell, **more: f(docs, payload, per_cell=n, **more))
        got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in fp.edit_likeness(frame(spark)).collect()]
        monkeypatch.undo()
        assert sorted(got) == expected(documents())


def test_one_row_and_no_rows(spark):
    assert fp.edit_likeness(empty(spark)).collect() == []
    assert fp.fingerprint(empty(spark)).collect() == []
    one = fp.edit_likeness(frame(spark, documents()[:1])).first()
    assert one["near_next"] == 1.0


def test_collisions_in_the_edited_texts(spark, monkeypatch):
    """All digests equal: fingerprints must still tell all texts apart."""
    monkeypatch.setattr(fp, "_bucket", lambda h1, h2: F.when(h1 == h2, "never").otherwise("same"))
    rows = fp.edit_likeness(frame(spark)).collect()
    texts = {}
    for r in rows:
        texts.setdefault(r["edited_fingerprint"], set()).add(r["edited_sha256"])
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows) == expected(documents())
    assert len({r["fingerprint"] for r in rows} | set(texts)) > 10


def test_cells_follow_the_ids(spark):
    """One far id, a crowded one and nulls: cells stay small, places are those of the order."""
    rows = [(i, f"text {i * 7919 % 1000}") for i in range(1500)] + [(1 << 62, "far"), (-(1 << 63), "least")]
    rows += [(700, f"{i * 31 % 1009:04d} crowded") for i in range(1000)] + [(None, f"{i * 17 % 1013:04d} none") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = []
    original = fp.with_next

    def seen(docs, payload, **more):
        return original(docs, payload, derive=lambda r: sizes.append(r.groupBy("__fp_cell").count().agg(F.max("count")).first()[0]) or r, **more)

    got = [(r["doc_id"], r["text"], r["next_text"]) for r in seen(df, ["text"], per_cell=50).collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert max(sizes) <= 300


def test_cells_are_parted_beyond_the_coarse_ones(spark, monkeypatch):
    """The largest cell follows the rows a cell, not the input: three sizes, with nulls, ties and a crowded id."""
    monkeypatch.setattr(fp, "MOST_CELLS", 8)
    for n in (400, 1600, 6400):
        rows = [(i * i, f"text {i * 7919 % 1000}") for i in range(n)] + [(9, "again"), (None, "none"), (None, "nothing")]
        rows += [(121, f"{i * 31 % 1009:04d} crowded") for i in range(n // 2)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        sizes = []
        done = fp.with_next(df, ["text"], per_cell=20, derive=lambda r, s=sizes: s.append(r.where("doc_id <> 121").groupBy("__fp_cell").count().agg(F.max("count")).first()[0]) or r)
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"], r["next_text"])) for r in done.collect())
        assert max(sizes) <= 100, (n, sizes)


def test_edit_likeness_with_joins_for_flags_and_parted_cells(spark, monkeypatch):
    monkeypatch.setattr(fp, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(fp, "MOST_CELLS", 2)
    original = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda docs, payload, **more: original(docs, payload, per_cell=2, **more))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in fp.edit_likeness(frame(spark)).collect()]
    assert sorted(got) == expected(documents())
    monkeypatch.setattr(fp, "_bucket", lambda h1, h2: F.when(h1 == h2, "never").otherwise("same"))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in fp.edit_likeness(frame(spark)).collect()]
    assert sorted(got) == expected(documents())


def test_flags_let_all_members_through(spark, monkeypatch):
    df = spark.range(5000)
    keys = spark.range(0, 5000, 50).withColumnRenamed("id", "key")
    kept = {r["id"] for r in fp._flagged(df, F.col("id"), keys).collect()}
    assert set(range(0, 5000, 50)) <= kept and len(kept) < 1000
    monkeypatch.setattr(fp, "MOST_BITS", 1 << 10)
    joined = fp._flagged(df, F.col("id"), keys)
    assert sorted(r["id"] for r in joined.collect()) == list(range(0, 5000, 50)) and joined.columns == df.columns
