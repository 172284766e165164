"""Top rows by group, vote and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Map tasks keep k rows a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def vote(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least of equally frequent ones, and its ``votes``."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("less"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.v").alias(value), (-F.col("b.less")).alias("votes"))
