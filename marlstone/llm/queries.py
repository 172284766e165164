"""The registered queries of this package: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, conversation_repair, fingerprints, importance, langid, line_dedup, mixing, near_duplicates, pieces, pii, quality, substring_dedup, url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Null, empty and repeated rows have the results that the operator's docstring states;
# an empty table gives no rows; columns that are not named there are not read.


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text, see ``edit_likeness``: a row a document, null texts being empty."""
    return fingerprints.edit_likeness(_table(spark, sf_dir, "documents"))


def _dated_list(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts of ``pages``, as the tables hold none.

    Four in seven hosts are listed, on a day of 2024 that md5 of the host gives; of
    these some are taken off 90 days later, and of these some listed again after
    60 more.  Two in five of the domains of two labels that hosts lie under are
    listed as ``network`` for 120 days, and two in five, some of them the same, as ``tracker``.
    """
    digit = lambda i: F.conv(F.substring(F.md5("domain"), i, 4), 16, 10).cast("int")
    hosts = pages.select(url_lists.host(F.col("url")).alias("domain")).where("domain IS NOT NULL").distinct()
    first = F.date_add(F.lit("2024-01-01").cast("date"), digit(1) % 200)
    steps = F.array(
        F.struct(F.lit(True).alias("listed"), first.alias("since")),
        F.struct(F.lit(False).alias("listed"), F.when(digit(5) % 2 == 0, F.date_add(first, 90)).alias("since")),
        F.struct(F.lit(True).alias("listed"), F.when(digit(5) % 4 == 0, F.date_add(first, 150)).alias("since")),
    )
    category = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), digit(9) % 3 + 1)
    listed = hosts.where(digit(13) % 7 < 4).select("domain", category.alias("category"), F.inline(steps))
    above = hosts.select(F.substring_index("domain", ".", -2).alias("domain")).where("domain LIKE '%.%'").distinct()
    wide = [
        above.where(digit(place) % 5 < 2).select("domain", F.lit(name).alias("category"), F.inline(F.array(
            F.struct(F.lit(True).alias("listed"), first.alias("since")), F.struct(F.lit(False).alias("listed"), F.date_add(first, 120).alias("since"))
        )))
        for name, place in (("network", 17), ("tracker", 21))
    ]
    entries = listed.unionByName(wide[0]).unionByName(wide[1]).where("since IS NOT NULL")
    return entries.withColumn("since", F.col("since").cast("timestamp_ntz"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the list of its fetch day, see ``evaluate``: a row a page, also those without a host."""
    pages = _table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).cast("timestamp_ntz")
    return url_lists.evaluate(pages.select("page_id", "url", day.alias("fetched_at")), _dated_list(pages))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of each document, see ``classes``: a row a document; equal texts, null and empty ones too, are copies."""
    return near_duplicates.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document, see ``assess``: a row a document; a null text has no words and fails."""
    return quality.assess(_table(spark, sf_dir, "documents"), fitted=quality.SAMPLE)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document, see ``detect``: a row a document; a null or empty text has none."""
    return pii.detect(_table(spark, sf_dir, "documents"))


#: The mix of op6 and of the pipeline: 97 % of the entropy of equal weights, no source more than four times.
MIX = mixing.Target(evenness=0.97, repeats=4.0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn, see ``mix``: a row a document; a null source is one of its own."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, MIX).select("doc_id", "source", "n_tokens", "copies")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and a digest of the rest, see ``dedup``: a row a document; a null text has no lines, an empty one has one."""
    out = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document, see ``predict``, learned from those not held out: a row a document, ``und`` for null and empty texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    return langid.predict(docs, net).withColumn("held_out", langid.held_out(F.col("doc_id")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and a digest of the rest, see ``dedup``: a row a document; null and empty texts have no words."""
    out = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("repeats").cast("long").alias("n_repeats"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, a digest of the ids and whether they decode to the text, see ``round_trip``: a row a document; null and empty texts have no tokens."""
    return pieces.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of each document, see ``score``, learned from those not held out: a row a document; null and empty texts are their end alone."""
    return context_mixing.score(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of each damaged conversation, see ``repair``: a row a conversation, also those of which nothing is left."""
    turns = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(turns), turns.select("conv_id"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document towards ``benchmark``, see ``resample``: a row a document; null and empty texts have no features."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# What SQL can say of operators whose whole result it cannot: the same rows with fewer columns.


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts of ``op1_fingerprints``."""
    return op1_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of ``op4_quality_rules``."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of ``op5_pii``."""
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def unigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base scores of ``op11_context_mixing``."""
    return op11_context_mixing(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_url_filters": op2_url_filters,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality_rules": op4_quality_rules,
    "op5_pii": op5_pii,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_context_mixing": op11_context_mixing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance_resampling": op13_importance_resampling,
    "fingerprint_edits": fingerprint_edits,
    "quality_counts": quality_counts,
    "pii_base": pii_base,
    "unigram_scores": unigram_scores,
}
