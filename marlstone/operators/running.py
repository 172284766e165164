"""Running sums over an order that no single task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import kept


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with ``place`` (from 1) and running sums of whole numbers within each group, in an order that must tell rows apart.

    Rows are dealt into ranges of (group, order), so a group of any size is spread; each
    range is summed, and the sums of the ranges before are added.  What is summed over
    ranges has a row for each range and group in it.
    """
    columns = df.columns
    values = {"place": F.lit(1), **sums}
    ranged = df.withColumns({f"__{n}": c.cast("long") for n, c in values.items()}).repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    ranged = kept(ranged, "ranges")
    whole = ranged.groupBy(*by, "__range").agg(*[F.sum(f"__{n}").alias(f"__all_{n}") for n in values])
    before = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select(*by, "__range", *[F.coalesce(F.sum(f"__all_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in values])
    inside = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.select(*columns, "__range", *[F.sum(f"__{n}").over(inside).alias(f"__upto_{n}") for n in values])
    return placed.join(offsets, [*by, "__range"]).select(*columns, *[(F.col(f"__upto_{n}") + F.col(f"__before_{n}")).alias(n) for n in values])
