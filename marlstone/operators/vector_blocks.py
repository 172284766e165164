"""Exact vector neighbours of many queries: slices of the vectors and blocks of queries meet as matrices.

A pair costs a few nanoseconds there, where a fold over two arrays costs microseconds, and a
meeting sends back at most k rows a query, so pairs are neither sorted nor shuffled.  The product
of matrices only says which pairs may be among the first k: those are summed
again in order of position, as ``dot`` does, so scores and ties are the same to the last bit.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot, vector_bytes
from ..sources import kept
from .joins import few_copies, in_blocks
from .ranking import top_k
from .vector_index import _found, _matrix

#: Bytes of the vectors of a slice, and of a block of queries; pairs of a product that is held.
SLICE_BYTES, QUERY_BYTES = 8 << 20, 16 << 20
PAIRS = 1 << 20
#: Numbers up to which sums and products stay far from infinity.
LARGE = 1e100


def plain(vector: Column, dimension: int) -> Column:
    """Whether a vector has ``dimension`` numbers, none null, NaN or beyond ``LARGE``."""
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < LARGE, F.lit(False))), F.lit(False))


def differing(a: Column, b: Column, words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(words)])


def block_top_k(base: DataFrame, queries: DataFrame, k: int, bits: int = 0, most: int = 0, dimension: int | None = None) -> DataFrame:
    """``query_id, id, rank, score``: the k greatest inner products of each query id among rows of other ids, ties by smaller id.

    base: ``id, v``, queries: ``query_id, q``; with ``bits`` also sketches ``__b`` and ``__q``, and only pairs
    that differ in ``most`` bits at most count.  Vectors of another length than ``dimension`` (the commonest unless given), or that hold
    nulls, NaN or numbers too large, are joined pair by pair; a score of NaN is the greatest, a null one the least.
    """
    base = kept(base.where("id IS NOT NULL"), "vectors")
    if dimension is None:
        sizes = base.where("v IS NOT NULL").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimension = sizes[0] if sizes else 0
    queries = kept(few_copies(queries.where("query_id IS NOT NULL"), k), "queries")
    fits, asked_fits = plain(F.col("v"), dimension), plain(F.col("q"), dimension)
    # Of equal vectors only those of the least ids can be among the first k: 2k of them, as k may have the query's own id.
    few = kept(top_k(few_copies(base.where(fits), k), ["v"], [F.col("id")], 2 * k).drop("rank"), "few-vectors")
    found = [best_pairs(few, queries.where(asked_fits), k, most if bits else None)]
    odd = ([(base.where(~fits), queries)] if not base.where(~fits).isEmpty() else []) + ([(base.where(fits), queries.where(~asked_fits))] if not queries.where(~asked_fits).isEmpty() else [])
    for rows, asked in odd:
        near = F.col("id") != F.col("query_id")
        if bits:
            near &= differing(F.col("__q"), F.col("__b"), bits // 64) <= most
        found += [rows.join(block, near).select("query_id", "id", dot(F.col("q"), F.col("v")).alias("score")) for block in in_blocks(asked, ["query_id", "q"], vector_bytes(F.col("q")) + bits // 8)]
    return top_k(reduce(DataFrame.unionByName, found), ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "id", "rank", "score")


def best_pairs(base: DataFrame, queries: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """``query_id, id, score``: of each meeting of a slice and a block the first k rows of a query, for plain vectors of one length."""
    rows, width = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    row_bytes = 8 * max(width or 1, 1)
    slices, blocks = max(1, -(-rows * row_bytes // SLICE_BYTES)), max(1, -(-queries.count() * row_bytes // QUERY_BYTES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    numbers = lambda c: F.col(c).cast("array<double>").alias(c)
    b, p = (["__b"], ["__q"]) if most is not None else ([], [])
    left = queries.select("query_id", numbers("q"), *p, dealt(blocks, "query_id", "q").alias("block")).select("*", each(slices).alias("slice"))
    right = base.select("id", numbers("v"), *b, dealt(slices, "id", "v").alias("slice")).select("*", each(blocks).alias("block"))

    def meet(key, asked, there):
        out: tuple[list, list, list] = ([], [], [])
        if not asked.num_rows or not there.num_rows:
            return _scored(out)
        names, q = asked["query_id"].to_numpy(), _matrix(asked["q"].combine_chunks())
        ids, x = there["id"].to_numpy(), _matrix(there["v"].combine_chunks())
        # Sums in two orders differ by less.
        slack = 8 * max(x.shape[1], 1) * np.finfo(float).eps * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1).max())
        sides = None if most is None else [np.array(t[c].to_pylist(), np.int64).view(np.uint64) for t, c in ((asked, "__q"), (there, "__b"))]
        last, step = max(len(ids) - k, 0), max(1, PAIRS // len(ids))
        for a in range(0, len(q), step):
            near = q[a : a + step] @ x.T
            near[names[a : a + step, None] == ids] = -np.inf
            if sides is not None:
                apart = np.zeros(near.shape, np.uint16)
                for word in range(sides[0].shape[1]):
                    apart += np.bitwise_count(sides[0][a : a + step, word, None] ^ sides[1][:, word])
                near[apart > most] = -np.inf
            floor = np.partition(near, last, axis=1)[:, last] - slack[a : a + step]
            row, at = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
            score = np.zeros(len(row))
            for j in range(x.shape[1]):
                score += q[a + row, j] * x[at, j]
            order = np.lexsort((ids[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            for held, new in zip(out, (names[a + row[first]], ids[at[first]], score[first]), strict=True):
                held.append(new)
        return _scored(out)

    keys = ["slice", "block"]
    n = max(2, slices * blocks)
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score double")


def _scored(out: tuple[list, list, list]) -> pa.Table:
    return _found(*out).rename_columns(["query_id", "id", "score"])
