"""Approximate vector neighbours by random hyperplanes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import kept
from .vector_blocks import block_top_k, differing  # noqa: F401


def sketches(vector: Column, dimension: int, bits: int, seed: int) -> Column:
    """The sides of ``bits`` random hyperplanes that a vector lies on, 64 to a long; null for another length."""

    @F.pandas_udf("array<long>")
    def code(vectors: pd.Series) -> pd.Series:
        planes = np.random.default_rng(seed).standard_normal((dimension, bits))
        fits = vectors.map(lambda v: v is not None and len(v) == dimension)
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        if fits.any():
            sides = np.stack(vectors[fits].to_list()).astype(np.float64) @ planes > 0
            out[fits] = pd.Series(list(np.packbits(sides, axis=1).view(np.int64)), index=vectors.index[fits])
        return out

    return code(vector)


def cut_off(base: DataFrame, queries: DataFrame, share: float, sample: int) -> int:
    """Differing bits up to which about ``share`` of all pairs lie, by ``sample`` rows of base and of queries at most."""
    some = lambda df, c: np.array([r[0] for r in df.where(F.col(c).isNotNull()).orderBy(F.xxhash64(c)).select(c).limit(sample).collect()], np.int64).view(np.uint64)
    a, b = some(base, "__b"), some(queries, "__q")
    if not len(a) or not len(b):
        return 0
    counts = [np.bitwise_count(x ^ a).sum(axis=1) for x in b]  # of signed numbers it would count those of the absolute value
    return int(np.quantile(np.concatenate(counts), share))


def lsh_top_k(base: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, bits: int = 512, share: float = 0.15, sample: int = 1000, seed: int = 42) -> DataFrame:
    """``query_id, id_col, rank, score`` of the k best inner products among the rows whose sketch is near the query's.

    All base rows are sketched and compared by bits, slices of them with blocks of queries; only pairs
    below a cut-off, about ``share`` of all, count.  A block's products are one product of matrices, which costs less than
    picking pairs for it, see ``block_top_k``.  The cut-off comes from a bounded
    sample; more bits give more recall at the same share.  Vectors that are null or
    of another length than the first match nothing.
    """
    one = base.where(F.col(vector_col).isNotNull()).select(F.size(vector_col)).first()
    dimension = one[0] if one else 0
    of_size = F.size(vector_col) == dimension
    b = kept(base.where(of_size).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), sketches(F.col(vector_col), dimension, bits, seed).alias("__b")), "sketches")
    q = kept(queries.where(of_size).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q"), sketches(F.col(vector_col), dimension, bits, seed).alias("__q")), "query-sketches")
    most = cut_off(b, q, share, sample)
    found = block_top_k(b, q, k, bits, most, dimension)
    return found.select("query_id", F.col("id").alias(id_col), "rank", F.round("score", 6).alias("score"))
