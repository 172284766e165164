"""Sketches that are stored by cell, as day and kind, and merged over any cells: distinct values and quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hashes are below this.
RANGE = 1 << 60
#: Added to the buckets of sizes, so that they are above 0 for all doubles at an error of a hundredth.
SHIFT = 100_000


def hash60(value: Column) -> Column:
    """The first 60 bits of md5 of a value's text; null for null."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 15), 16, 10).cast("long")


def least_hashes(df: DataFrame, by: list[str], value: Column, k: int) -> DataFrame:
    """A row for each of the ``k`` least hashes of different values of a cell, ``by, h``: at most k rows a cell, however many values it has.  Nulls count not at all."""
    return _least(df.select(*by, hash60(value).alias("h")).where("h IS NOT NULL"), by, k)


def _least(hashes: DataFrame, by: list[str], k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*by).orderBy("h"))
    return hashes.select(*by, "h").distinct().withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def distinct_values(sketch: DataFrame, by: list[str], k: int) -> DataFrame:
    """``by, n, exact``: different values of the cells of ``sketch`` that fall together under ``by``; exact below ``k``, else by the k-th least hash, with a standard error of about 1 / sqrt(k)."""
    merged = _least(sketch, by, k).groupBy(*by).agg(F.count(F.lit(1)).alias("held"), F.max("h").alias("last"))
    estimate = F.round((k - 1) * F.lit(float(RANGE)) / F.col("last"), 3)
    return merged.select(*by, F.when(F.col("held") < k, F.col("held").cast("double")).otherwise(estimate).alias("n"), (F.col("held") < k).alias("exact"))


def _log_base(error: float) -> float:
    return math.log((1 + error) / (1 - error))


def log_histogram(df: DataFrame, by: list[str], value: Column, error: float) -> DataFrame:
    """``by, bucket, n``: values by buckets whose ends differ by a factor of (1 + error) / (1 - error); 0 is bucket 0, and nulls and NaN are left out.

    Buckets grow with the value: a negative one has that of its size with a minus sign.
    """
    base = _log_base(error)
    size = F.ceil(F.log(F.abs(F.col("__v"))) / F.lit(base)).cast("long") + SHIFT
    bucket = F.when(F.col("__v") == 0, F.lit(0).cast("long")).when(F.col("__v") > 0, size).otherwise(-size)
    return df.select(*by, value.cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)").groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str], q: float, error: float) -> DataFrame:
    """``by, n, value``: the value whose rank is ceil(q n) in the merged cells, off by a factor of 1 + error at most."""
    base = _log_base(error)
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))  # buckets are few, whatever the number of rows
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("bucket"))
    total = F.sum("n").over(W.partitionBy(*by))
    hit = merged.select(*by, "bucket", upto.alias("upto"), total.alias("total")).where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total"))))
    first = hit.groupBy(*by).agg(F.min("bucket").alias("bucket"), F.first("total").alias("n"))
    middle = (1 - error) * F.exp((F.abs("bucket") - SHIFT) * F.lit(base))
    return first.select(*by, "n", F.when(F.col("bucket") == 0, 0.0).otherwise(F.signum("bucket") * middle).alias("value"))
