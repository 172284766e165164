"""Inverted index with bounds, and ranked retrieval that scores only what can still reach the first k.

Scores are BM25 with a contribution of each term rounded to millionths, so that sums
are exact and ties are ties.  A search takes three steps: a floor from the query's
most telling terms; the lists of terms that a document above the floor must share;
and for what is left, by bounds of blocks of documents, single postings by (term, document).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import kept, scratch
from .ranking import top_k

K1, B = 1.2, 0.75
UNIT = 1_000_000
#: Documents in a block.
BLOCK = 16
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


@dataclass(frozen=True)
class TextIndex:
    """postings: ``term, doc_id, block, impact``, spread by (document, term) and sorted in each file; terms: ``term, idf, most``; bounds: ``term, block, most``."""

    postings: DataFrame
    terms: DataFrame
    bounds: DataFrame
    documents: int

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str) -> TextIndex:
        """Index all rows; ids must be distinct and not null.  A term that every document holds lies in all files, none of them holds it whole."""
        spark = docs.sparkSession
        words = docs.select(F.col(id_col).alias("doc_id"), terms(F.col(text_col)).alias("w"))
        n, mean = words.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("w")), F.lit(0.0))).first()
        counted = words.select("doc_id", F.size("w").alias("size"), F.explode("w").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))
        long = F.lit(1 - B) + F.lit(B) * F.col("size") / F.lit(mean or 1.0)
        impact = F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * long)
        block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // BLOCK))))
        path = scratch(spark, "text-index")
        counted.select("term", "doc_id", block.alias("block"), impact.alias("impact")).sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        postings = spark.read.parquet(f"{path}/postings")
        postings.groupBy("term", "block").agg(F.max("impact").alias("most"), F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/bounds")
        bounds = spark.read.parquet(f"{path}/bounds")
        df = F.sum("n")
        bounds.groupBy("term").agg(F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)).alias("idf"), F.max("most").alias("most")).write.parquet(f"{path}/terms")
        return cls(postings, spark.read.parquet(f"{path}/terms"), bounds, n)

    def search(self, queries: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
        """``query_id, doc_id, rank, score``: the k documents of the greatest scores, ties by smaller id; the same rows as by scoring all postings.

        A query counts each of its terms once; a query without known terms finds nothing.
        """
        asked, floors = self._floors(queries, id_col, text_col, k)
        needed, rest, left = self._survivors(asked, floors)
        more = left.select("query_id", "doc_id").join(rest, "query_id").join(self.postings, ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sum(_worth("impact")).alias("more"))
        scored = left.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("part") + F.coalesce("more", F.lit(0))).alias("points"))
        best = top_k(scored, ["query_id"], [F.desc("points"), F.col("doc_id")], k)
        return best.select("query_id", "doc_id", "rank", (F.col("points") / UNIT).alias("score"))

    def postings_read(self, queries: DataFrame, id_col: str, text_col: str, k: int) -> tuple[int, int]:
        """Postings that a search joins, and those that scoring everything would."""
        asked, floors = self._floors(queries, id_col, text_col, k)
        needed, rest, left = self._survivors(asked, floors)
        telling = asked.where("place * 3 <= n + 2").join(self.postings, "term").count()
        read = telling + needed.join(self.postings, "term").count()
        return read + left.join(rest, "query_id").join(self.postings, ["term", "doc_id"]).count(), asked.join(self.postings, "term").count()

    def _floors(self, queries: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
        """Known terms of each query with their greatest contributions, and a score that k documents have: those that lead by a third of the terms, the most telling."""
        asked = queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).join(self.terms, "term")
        by = W.partitionBy("query_id").orderBy(F.desc("bound"), "term")
        asked = asked.withColumn("bound", _worth("most")).select(
            "query_id", "term", "idf", "bound", F.row_number().over(by).alias("place"), F.count(F.lit(1)).over(W.partitionBy("query_id")).alias("n"),
            # What this and all less telling terms can give together.
            F.sum("bound").over(by.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("below"),
        )
        asked = kept(asked, "query-terms")
        telling = asked.where("place * 3 <= n + 2").join(self.postings, "term").groupBy("query_id", "doc_id").agg(F.sum(_worth("impact")).alias("part"))
        hopeful = top_k(telling, ["query_id"], [F.desc("part"), F.col("doc_id")], 2 * k).select("query_id", "doc_id")
        whole = hopeful.join(asked, "query_id").join(self.postings, ["term", "doc_id"]).groupBy("query_id", "doc_id").agg(F.sum(_worth("impact")).alias("part"))
        best = top_k(whole, ["query_id"], [F.desc("part"), F.col("doc_id")], k)
        return asked, best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("part")).otherwise(F.lit(0)).alias("floor"))

    def _survivors(self, asked: DataFrame, floors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Terms of which a document above the floor has at least one; the others; documents that may reach it, with what the first give."""
        judged = kept(asked.join(floors, "query_id"), "judged-terms")
        needed, rest = judged.where("below >= floor"), judged.where("below < floor").select("query_id", "term", "idf", "bound", "floor")
        part = needed.join(self.postings, "term").groupBy("query_id", "doc_id", "block", "floor").agg(F.sum(_worth("impact")).alias("part"))
        limit = rest.groupBy("query_id").agg(F.sum("bound").alias("limit"))
        left = kept(part.join(limit, "query_id", "left").where("part + coalesce(limit, 0) >= floor").drop("limit"), "candidates")
        blocks = left.select("query_id", "block").distinct().join(rest, "query_id").join(self.bounds, ["term", "block"]).groupBy("query_id", "block").agg(F.sum(_worth("most")).alias("limit"))
        return needed, rest, left.join(blocks, ["query_id", "block"], "left").where("part + coalesce(limit, 0) >= floor").drop("limit")


def _worth(impact: str) -> Column:
    """A contribution in millionths; it grows with the impact, so the greatest impact bounds it."""
    return F.round(F.lit(float(UNIT)) * F.col("idf") * F.col(impact)).cast("long")
