"""Pairs of sets that are alike, by their rarest members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import kept
from .joins import small

#: Counts by which members are ordered; members that share a slot count as one, which any order allows.
SLOTS = 1 << 22
#: A pair must share one early member more for so many members of the smaller set.
STEP = 32


def spread(sets: DataFrame, set_col: str) -> np.ndarray:
    """How many sets hold the members of each slot: of a fixed size, whatever the sets are."""
    held = sets.select(F.explode(set_col).alias("member")).select(F.pmod(F.xxhash64("member"), F.lit(SLOTS)).cast("int").alias("slot"))
    counts = np.zeros(SLOTS, np.int32)
    found = held.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).select("slot", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def early(sets: DataFrame, id_col: str, set_col: str, tenths: int) -> DataFrame:
    """``id, n, member, left``: the first members of each set by rarity, as hashes, and how many come after each; those that no other set holds are left out."""
    counts = sets.sparkSession.sparkContext.broadcast(spread(sets, set_col))

    def first(batches):
        for batch in batches:
            held, n = batch.column(1).flatten().to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            often = counts.value[held % SLOTS]
            order = np.lexsort((held, often, row))
            held, often = held[order], often[order]
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
            size = n[row]
            some = np.flatnonzero((place <= size + (-size * tenths // 10) + 1 + size // STEP) & (often > 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), *(pa.array(x[some].astype(kind)) for x, kind in ((size, np.int32), (held, np.int64), (size - place, np.int32)))], ["id", "n", "member", "left"])

    hashed = sets.select(F.col(id_col).alias("id"), F.transform(set_col, lambda x: F.xxhash64(x)).alias("held"), F.size(set_col).alias("n"))
    return hashed.mapInArrow(first, f"id {sets.schema[id_col].dataType.simpleString()}, n int, member long, left int")


def similar_sets(sets: DataFrame, id_col: str, set_col: str, tenths: int) -> DataFrame:
    """``a, b, shared, merged``: all pairs (a < b) of different ids whose sets have a Jaccard likeness of ``tenths`` / 10 at least.

    Exact: of two sets that must share t members, in any common order the r-th shared one leaves t - r at least in both. So pairs
    whose early members leave room are counted, the rarest members first, and k of them must be found, k by the smaller
    set: few pairs have so many that are not alike. Only the sets of those are then compared, as they are.
    ids must be distinct, members of a set too; empty sets are in no pair.
    """
    rows = kept(early(sets, id_col, set_col, tenths), "early-members")
    a, b = (rows.select("member", F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("left").alias(f"left_{i}")) for i in "ab")
    k = "1 + least(n_a, n_b) DIV {STEP}".format(STEP=STEP)
    wanted = f"(({tenths}L * (n_a + n_b) + {9 + tenths}) DIV {10 + tenths})"
    met = a.join(b, "member").where(f"a < b AND n_a * 10 >= n_b * {tenths} AND n_b * 10 >= n_a * {tenths} AND {k} + least(left_a, left_b) >= {wanted}")
    often = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("found"), F.first(F.expr(k)).alias("k"))
    pairs = kept(often.where("found >= k").select("a", "b"), "pairs")
    ids = kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired")
    some = kept(sets.select(F.col(id_col).alias("id"), F.col(set_col).alias("held")).join(small(ids), "id", "left_semi"), "paired-sets")
    whole = lambda i: some.select(F.col("id").alias(i), F.col("held").alias(f"set_{i}"))
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    both = pairs.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return both.select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("merged")).where(F.col("shared") * 10 >= F.col("merged") * tenths)
