"""Traversal of a table of edges to its fixpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import kept
from .joins import small

#: Numbers of 64 bits in a row of ``led_to``, a bit a start; edges that a round follows.
WORDS, HOPS = 4, 2


def reachable(edges: DataFrame, starts: DataFrame, most_steps: int | None = None) -> DataFrame:
    """``start, node, steps``: every node that paths from a start lead to, by the fewest edges; a start is its own node at 0 steps.

    edges: ``src, dst``; starts: ``start``; nulls lead nowhere.  Up to 64 starts, near by id, are bits of a number, so
    that those that lead to the same nodes go there together, a row for a node and not for each pair.  Semi-naive: a round joins
    only the bits that the last one found with the edges, and keeps those not seen
    before, until there are none, so cycles end.  Rounds are as many as the longest of
    the shortest paths; each is a table in the shared folder.  Pairs are made of the bits at the end.
    """
    e = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    e = kept(e, "edges")
    dealt = starts.select("start").where("start IS NOT NULL").distinct().orderBy("start").withColumn("i", F.monotonically_increasing_id())
    dealt = kept(dealt.selectExpr("start", "i DIV 64 AS block", "shiftleft(1L, CAST(i % 64 AS int)) AS bit"), "starts")
    fresh = kept(dealt.select("block", F.col("start").alias("node"), F.col("bit").alias("bits")), "frontier")
    seen, found, steps = fresh, [fresh.withColumn("steps", F.lit(0))], 0
    while fresh.take(1) and (most_steps is None or steps < most_steps):
        steps += 1
        reached = fresh.join(e, F.col("node") == F.col("src")).groupBy("block", F.col("dst").alias("node")).agg(F.bit_or("bits").alias("reached"))
        new = F.col("reached").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0))))
        fresh = kept(reached.join(seen, ["block", "node"], "left").select("block", "node", new.alias("bits")).where("bits <> 0"), "frontier")
        seen = kept(seen.unionByName(fresh).groupBy("block", "node").agg(F.bit_or("bits").alias("bits")), "seen")
        found.append(fresh.withColumn("steps", F.lit(steps)))
        if len(found) > 16:  # a union of few tables
            found = [kept(reduce(DataFrame.unionByName, found), "reached")]
    return reduce(DataFrame.unionByName, found).join(small(dealt), "block").where("bits & bit <> 0").select("start", "node", "steps")


def led_to(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node``: the pairs of ``reachable`` without their steps, in fewer and shorter rounds.

    A round follows ``HOPS`` edges: bits that the last one found go to the next nodes, and from there on, staying too, as nodes
    lead to themselves. What was seen and what came meet once, in one table a round, where what is new is told from the rest.
    """
    e = kept(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    stay = kept(e.unionByName(e.select(F.col("dst").alias("src"), "dst").distinct()), "edges-and-nodes")
    dealt = starts.select("start").where("start IS NOT NULL").distinct().orderBy("start").withColumn("i", F.monotonically_increasing_id())
    dealt = kept(dealt.selectExpr("start", f"i DIV {64 * WORDS} AS block", f"CAST(i DIV 64 % {WORDS} AS int) AS word", "shiftleft(1L, CAST(i % 64 AS int)) AS bit"), "starts")
    words = range(WORDS)
    some = " OR ".join(f"new{w} <> 0" for w in words)
    state = kept(dealt.selectExpr("block", "start AS node", *(f"IF(word = {w}, bit, 0L) AS {k}{w}" for k in ("seen", "new") for w in words)), "reached")
    while state.where(some).take(1):
        sent = state.where(some).select("block", "node", *(f"new{w}" for w in words))
        for hop in range(HOPS):
            if hop:
                sent = sent.groupBy("block", "node").agg(*(F.bit_or(f"new{w}").alias(f"new{w}") for w in words))
            sent = sent.join(stay if hop else e, F.col("node") == F.col("src")).select("block", F.col("dst").alias("node"), *(f"new{w}" for w in words))
        held = state.selectExpr("block", "node", *(f"seen{w}" for w in words), *(f"0L AS new{w}" for w in words))
        came = sent.selectExpr("block", "node", *(f"0L AS seen{w}" for w in words), *(f"new{w}" for w in words))
        met = held.unionByName(came).groupBy("block", "node").agg(*(F.bit_or(f"{k}{w}").alias(f"{k}{w}") for k in ("seen", "new") for w in words))
        state = kept(met.selectExpr("block", "node", *(f"seen{w} | new{w} AS seen{w}" for w in words), *(f"new{w} & ~seen{w} AS new{w}" for w in words)), "reached")
    own = "CASE word " + " ".join(f"WHEN {w} THEN seen{w}" for w in words) + " END"
    return state.join(small(dealt), "block").where(f"{own} & bit <> 0").select("start", "node")
