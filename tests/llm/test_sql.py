from __future__ import annotations

import hashlib

import numpy as np
import pytest

from marlstone.llm.queries import QUERIES
from marlstone.llm.sql import ORACLE
from tests.compare import same
from tests.llm import test_context_mixing, test_fingerprints, test_pii, test_quality
from tests.llm.test_pieces import E

#: Columns that the task names for the queries that SQL cannot express; more may follow.
COLUMNS = {
    "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op10_sentencepiece": "doc_id n_tokens ids_sha256 round_trip",
    "op11_context_mixing": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLE[name]))


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {name: {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()} for name in COLUMNS}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_cover_all_documents(results, texts, name):
    assert set(results[name]) == set(texts)
    assert set(COLUMNS[name].split()) <= set(next(iter(results[name].values())).asDict())


def test_every_query_is_tested():
    assert set(COLUMNS) | set(ORACLE) == set(QUERIES)


def test_op1(results, texts):
    want = test_fingerprints.expected([(i, r["text"]) for i, r in texts.items()])
    assert sorted((str(i), *(r[c] for c in ("n_chars", "edited_sha256", "near_edited", "near_next"))) for i, r in results["op1_fingerprints"].items()) == want
    by = {}
    for i, r in results["op1_fingerprints"].items():
        by.setdefault(r["fingerprint"], set()).add(test_fingerprints.canonical(texts[i]["text"]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({test_fingerprints.canonical(r["text"]) for r in texts.values()})


def test_op4(results, texts):
    kept = test_quality.verdicts([(i, r["text"], r["lang"]) for i, r in texts.items()])
    for i, r in results["op4_quality_rules"].items():
        assert tuple(r[c] for c in COLUMNS["op4_quality_rules"].split()[1:7]) == test_quality.base(texts[i]["text"]) and r["kept"] == kept[i]


def test_op5(results, texts):
    for i, r in results["op5_pii"].items():
        found = test_pii.brute(texts[i]["text"])
        listed = [f"{k}:{a}:{b}" for k, spans in found.items() for a, b in spans]
        assert [r[f"n_{k}"] for k in found] == [len(v) for v in found.values()]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r["spans"].split(","))


def test_op8(results, texts):
    held = [i for i, r in results["op8_language_id"].items() if r["held_out"] and len(texts[i]["text"]) >= 100]
    assert sum(results["op8_language_id"][i]["lang_pred"] == texts[i]["lang"] for i in held) >= 0.98 * len(held) > 0


def test_op10(results, texts):
    for i, r in results["op10_sentencepiece"].items():
        ids = E.ids(texts[i]["text"])
        assert r["n_tokens"] == len(ids) and r["round_trip"] and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def test_op11(results, texts):
    want = test_context_mixing.base([(i, r["text"]) for i, r in texts.items()])
    for i, (tokens, known, n, score) in zip(texts, want, strict=True):
        r = results["op11_context_mixing"][i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and abs(r["base_score"] - score) < 1e-6 * max(1, abs(score)) and r["score"] < 0
    held = [results["op11_context_mixing"][i] for i in texts if results["op11_context_mixing"][i]["held_out"]]
    assert sum(-r["score"] for r in held) * np.log2(10) < 3 * sum(r["n_bytes"] for r in held)
