"""Sequences of events of one key: an automaton run backwards over its ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sequences(events: DataFrame, key: str, time: str, tie: str, kind: str, steps: list[str], seconds: int) -> DataFrame:
    """``key, id_1 .. id_n``: for each event of the first kind the next of the second after it, the next of the third after that and so on.

    ``tie`` tells events of one time apart and orders them; events of other kinds
    between are passed over, and one event may be in several sequences.  A sequence
    counts if its last event is at most ``seconds`` after its first.  Events without a
    key or time are left out.

    One shuffle and one sort, backwards in time: each row carries, for each step, the
    nearest row after it from which the pattern can be finished.  Frames run with the
    rows, so a key of any length streams through its task.
    """
    later = W.partitionBy("__key").orderBy(F.desc("__time"), F.desc("__tie")).rowsBetween(W.unboundedPreceding, -1)
    rows = events.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.col(tie).alias("__tie"), F.col(kind).alias("__kind")).where("__key IS NOT NULL AND __time IS NOT NULL")
    rows = rows.where(F.col("__kind").isin(steps))
    ends: Column = F.struct(F.col("__time").alias("last"), F.array("__tie").alias("ids"))
    rows = rows.withColumn("__step", F.when(F.col("__kind") == steps[-1], ends))
    for step in reversed(steps[:-1]):
        rows = rows.withColumn("__next", F.last("__step", ignorenulls=True).over(later))
        ends = F.struct(F.col("__next.last").alias("last"), F.concat(F.array("__tie"), F.col("__next.ids")).alias("ids"))
        rows = rows.withColumn("__step", F.when((F.col("__kind") == step) & F.col("__next").isNotNull(), ends))
    whole = rows.where(F.col("__step").isNotNull() & (F.col("__step.last") <= F.col("__time") + F.expr(f"INTERVAL {seconds} SECONDS")))
    return whole.select(F.col("__key").alias(key), *[F.col("__step.ids")[k].alias(f"id_{k + 1}") for k in range(len(steps))])
