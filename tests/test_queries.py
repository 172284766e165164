"""Every query outside the training-data package against its SQL."""

from __future__ import annotations

import pytest

from marlstone.plans.catalog import ORACLE, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_approximate_distinct_is_near(spark, sf_dir, duck):
    exact = dict(duck.sql("SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY 1").fetchall())
    for r in QUERIES["a3_approx_distinct"](spark, sf_dir).collect():
        assert abs(r["users"] - exact[r["event_type"]]) <= max(1, 0.06 * exact[r["event_type"]])


def test_vector_lsh_recall(spark, sf_dir):
    exact = {(r["query_id"], r["vec_id"]) for r in QUERIES["k2_vector_topk"](spark, sf_dir).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in QUERIES["u3_vector_lsh"](spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_minhash_pairs_are_true_pairs(spark, sf_dir):
    texts = {r["doc_id"]: set(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["u2_minhash_lsh"](spark, sf_dir).collect():
        a, b = texts[r["doc_a"]], texts[r["doc_b"]]
        assert abs(1 - len(a & b) / len(a | b) - r["distance"]) < 0.05  # words are hashed


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["k2_vector_topk"](spark, sf_dir).count() > 0


@pytest.mark.parametrize("gone", [("marlstone.llm",), ("corpus_pipeline",), ("marlstone.llm", "corpus_pipeline")])
def test_entry_without_optional_parts(monkeypatch, gone):
    import sys
    from importlib.util import find_spec

    import __spark_entry__ as e

    there = find_spec("marlstone.llm") is not None and "marlstone.llm" not in gone

    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name.startswith(gone):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    import marlstone

    monkeypatch.delattr(marlstone, "llm", raising=False)
    for name in [m for m in sys.modules if m.startswith(("marlstone.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    found = e.queries()
    assert set(QUERIES) <= set(found) and set(e.oracle_sql()) <= set(found)
    assert "pipeline" not in found and (set(found) > set(QUERIES)) == there


def test_entry_with_a_library_missing(monkeypatch):
    """A package that is there but cannot be imported is left out with a warning."""
    import __spark_entry__ as e

    def fails(name):
        raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")

    monkeypatch.setattr(e.importlib, "import_module", fails)
    with pytest.warns(UserWarning, match="ahocorasick"):
        assert set(e.queries()) == set(QUERIES)


def test_case_and_distance_beyond_ascii(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    texts = ["straße", "ÀÉ naïve ciónes", "plain ascii", "日本語 a", "", None, "X" * 300 + "é" * 64, "x" * 65, "Y" * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["up"], r["distance"]) for r in QUERIES["c3_case_distance_documents"](spark, str(tmp_path)).collect()}
    near = lambda n: n if n <= 64 else -1
    assert got == {k: (None, None) if t is None else (t.upper(), near(distance(t, t.upper()))) for k, t in enumerate(texts)}
