"""Python functions and approximate search."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import small
from ..operators.set_join import similar_sets
from ..operators.vector_lsh import lsh_top_k
from ..sources import kept, table
from .registry import query
from .relational import k2


@query("u1_scalar_udf", "SELECT n_nationkey, n_name, length(n_name) * 10 + n_regionkey AS code FROM nation")
def u1_scalar(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("long")
    def code(name: pd.Series, region: pd.Series) -> pd.Series:
        return name.str.len() * 10 + region

    return table(spark, d, "nation").select("n_nationkey", "n_name", code("n_name", "n_regionkey").alias("code"))


@query("u1_aggregate_udf", "SELECT event_type, round(stddev_samp(value), 6) AS spread FROM events GROUP BY event_type")
def u1_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Sums in pandas by map task, combined by Spark: no task holds a whole group."""

    def partial(frames):
        for f in frames:
            g = f.assign(sq=f["value"] ** 2).groupby("event_type").agg(n=("value", "size"), s=("value", "sum"), q=("sq", "sum")).reset_index()
            yield g

    sums = table(spark, d, "events").select("event_type", "value").mapInPandas(partial, "event_type string, n long, s double, q double")
    total = sums.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    return total.select("event_type", F.round(F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))), 6).alias("spread"))


@query("u1_table_udf", "SELECT doc_id, unnest(string_split(source, 'c')) AS part FROM documents")
def u1_table(spark: SparkSession, d: str) -> DataFrame:
    @F.udtf(returnType="part string")
    class Parts:
        def eval(self, text: str):
            for p in () if text is None else text.split("c"):
                yield (p,)

    return table(spark, d, "documents").select("doc_id", "source").lateralJoin(Parts(F.col("source").outer())).select("doc_id", "part")


@query(
    "u2_minhash_lsh",
    r"""WITH t AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
    w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM t),
    x AS (SELECT doc_id, len(w) AS n, unnest(w) AS v FROM w),
    p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.n + b.n - count(*) AS merged, count(*) AS shared
          FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n)
    SELECT doc_a, doc_b, round(1 - shared / merged, 6) AS distance FROM p WHERE 10 * shared >= 7 * merged""",
)
def u2(spark: SparkSession, d: str) -> DataFrame:
    """Near copies by their word sets, each different text once: all pairs of a Jaccard distance up to 0.3.

    Candidates are texts that share several of their rarest words, which misses none, see ``similar_sets``. Texts are told apart
    by digests and stay where they are read. Texts without words have no pairs.
    """
    docs = table(spark, d, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("h"))
    seen = kept(docs.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n")), "digests")
    firsts = seen.groupBy("h").agg(F.min("doc_id").alias("first"))
    others = kept(seen.join(firsts, "h").where("doc_id <> first").select("h", "doc_id"), "copies")
    texts = docs.join(small(others, 1_000_000), ["h", "doc_id"], "left_anti")
    if seen.where("n > 1").limit(1).count():  # rows that are repeated with their ids
        texts = texts.dropDuplicates(["h", "doc_id"])
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+").transform(texts.select("doc_id", "text"))
    bags = kept(words.select("doc_id", F.array_distinct("words").alias("bag")).where(F.size("bag") > 0), "bags")
    near = similar_sets(bags, "doc_id", "bag", 7)
    return near.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.round(1 - F.col("shared") / F.col("merged"), 6).alias("distance"))


@query(
    "u3_vector_lsh_recall",
    """SELECT query_id, 10 AS wanted, TRUE AS reached FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0)""",
)
def u3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether nine in ten of the exact neighbours of all queries are among the approximate ones."""
    exact, found = k2(spark, d).select("query_id", "vec_id"), u3(spark, d).select("query_id", "vec_id", F.lit(1).alias("hit"))
    by_query = exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("wanted"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    by_query = kept(by_query, "recall")  # both searches run once
    reached = bool(by_query.agg(F.sum("hits") / F.sum("wanted") >= 0.9).first()[0])
    return by_query.select("query_id", "wanted", F.lit(reached).alias("reached"))


@query("u3_vector_lsh")
def u3(spark: SparkSession, d: str) -> DataFrame:
    """Approximate ten nearest of every fiftieth vector among all vectors, which are all indexed."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return lsh_top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
