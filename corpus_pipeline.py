"""Corpus pipeline: five stages over ``documents``, each a Parquet table for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import langid, line_dedup, mixing, near_duplicates, pieces
from marlstone.llm.cluster import checkpoint_dir
from marlstone.llm.queries import MIX

#: A prediction below this share of certainty counts as no known language.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language.  Rejected: ``und`` and scores below ``LEAST_SCORE``.

    The network learns from the labelled documents that are not held out.  A null or
    empty text, or one without letters, is ``und``; an empty table stays empty, rows
    that repeat are judged alike.  All columns stay, but names that begin with
    ``__lang_`` are reserved.
    """
    net = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    columns = docs.columns
    judged = langid.predict(docs, net, keep=tuple(c for c in columns if c != "doc_id"), prefix="__lang_")
    known = (F.col("__lang_lang_pred") != langid.NONE) & (F.col("__lang_score") >= LEAST_SCORE)
    return _like(judged.where(known), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; ``n_chars`` is counted anew. All documents stay.

    A null text stays null, an empty one has one empty line, which stays; rows of one
    id do not remove each other's lines at one place.  All columns stay, but names
    that begin with ``__line_`` are reserved.
    """
    return _recounted(line_dedup.dedup(docs, counts=("__line_n", "__line_removed")), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates.

    Null and empty texts are equal texts, of which one stays, as does one of rows that
    repeat.  All columns stay, but names that begin with ``__near_`` are reserved.
    """
    return near_duplicates.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them: not at all, once or several times.

    A null source is one of its own; null and empty texts have no tokens and are drawn
    in whole passes.  All columns stay, but names that begin with ``__mix_`` are reserved.
    """
    names = ("__mix_tokens", "__mix_copies")
    return _like(mixing.realise(mixing.mix(docs, MIX, names=names), names), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids_sha256, round_trip`` of every document drawn; null and empty texts have no tokens."""
    return pieces.round_trip(docs.select("doc_id", "source", "text"))


def _like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def _recounted(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in like.columns])


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_duplicates", near), ("mixing", mix), ("sentencepiece", encode)]

#: Language ID, MinHash and the piece search have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
