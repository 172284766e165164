"""A text far beyond all chunk sizes goes through every operator, beside small ones."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

from marlstone.llm import fingerprints, langid, line_dedup, near_duplicates, pieces, pii, quality, substring_dedup
from tests.llm.frames import prose, words


def long_text() -> str:
    r = random.Random(3)
    vocabulary = [prose(k, 1) + str(k) for k in range(4000)]
    lines = [" ".join(r.choices(vocabulary, k=12)) for _ in range(60_000)]
    return "\n".join([*lines, "x" * 200_000, lines[5]])


@pytest.fixture(scope="module")
def text():
    return long_text()


@pytest.fixture(scope="module")
def docs(spark, text):
    rows = [(1, prose(1, 80), "en"), (2, text, "en"), (3, text + " end", "en"), (4, None, None), (5, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_batches_are_bounded_by_bytes(spark, docs, text):
    near_duplicates.small_batches(spark, mb=1)

    def sizes(batches):
        for b in batches:
            yield b.select([0]).slice(0, 1).set_column(0, "doc_id", pa.array([b.num_rows]))

    many = docs.where("doc_id = 2").select("doc_id", "text").union(docs.where("doc_id = 3").select("doc_id", "text")).coalesce(1)
    assert [r["doc_id"] for r in many.mapInArrow(sizes, "doc_id long").collect()] == [1, 1]


def test_counts_and_search(docs, text):
    got = by_id(quality.assess(docs))
    assert got[2]["n_words"] == len(words(text)) and got[2]["word_chars"] == sum(map(len, words(text))) and got[2]["n_dup_lines"] == 1
    assert by_id(pii.detect(docs))[2]["n_email"] == 0
    net = langid.Network.new(["a", "b"])
    assert by_id(langid.predict(docs, net))[2]["lang_pred"] in ("a", "b")


def test_pieces(docs):
    got = by_id(pieces.round_trip(docs))
    assert all(r["round_trip"] for r in got.values()) and got[3]["n_tokens"] > got[2]["n_tokens"] > 100_000


def test_dedup(docs, text):
    got = by_id(line_dedup.dedup(docs))
    assert got[2]["n_removed"] == 1 and got[3]["n_removed"] >= 60_001 and got[3]["n_lines"] == 60_002
    got = by_id(substring_dedup.dedup(docs))
    assert got[2]["n_removed"] == 0 and got[3]["kept"] == "end" and got[2]["kept"] == " ".join(words(text))
    got = by_id(near_duplicates.classes(docs))
    assert got[3]["class_id"] == 2 and got[3]["n_links"] == 1 and got[5]["class_id"] == 4


def test_fingerprints(docs, text):
    got = by_id(fingerprints.edit_likeness(docs))
    following = prose(1, 80)  # that of the next smaller id
    third = len(text) // 3
    edited = text[: len(text) - third] + following[:third]
    assert got[2]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[2]["fingerprint"] != got[3]["fingerprint"]
