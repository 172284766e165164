"""Vector index: inverted lists over k-means cells, with codes of what lies beyond the cell's centre.

Cells and codebooks are fitted on a bounded sample; every row is put into the list
of its cell with a code of ``dimension / 2`` bytes and the length of its error.  A
search sends a query to its nearest cells, an equi-join on (cell, slice); a task
holds one slice of a list and a block of queries and sends back only candidates, whose
vectors are fetched by id.  As codes come with their error, a search can also be
certified: every row whose code leaves room for a place among the first k is fetched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot
from ..sources import scratch
from .ranking import top_k

#: Rows of a list, and queries, that meet in one task.
SLICE_ROWS = 50_000
QUERY_ROWS = 20_000
LISTS = "cell int, slice int, id long, code binary, error double"


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of at most ``k`` groups of the rows of x; a group that loses all rows keeps its centre."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([np.argmax(x[a : a + block] @ centres.T - half, axis=1) for a in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass(frozen=True)
class Quantizer:
    """centres: of the cells; books: for each pair of dimensions (the last may be alone) its codewords."""

    centres: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, seed: int) -> Quantizer:
        centres = k_means(sample, cells, 12, seed)
        rest = sample - centres[_nearest(sample, centres)]
        return cls(centres, [k_means(rest[:, d : d + 2], 256, 6, seed + d) for d in range(0, sample.shape[1], 2)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and length of the error of each row."""
        cell = _nearest(x, self.centres)
        rest = x - self.centres[cell]
        code = np.stack([_nearest(rest[:, 2 * j : 2 * j + 2], book) for j, book in enumerate(self.books)], axis=1).astype(np.uint8)
        return cell, code, np.sqrt(((x - self.decode(cell, code)) ** 2).sum(1))

    def decode(self, cell: np.ndarray | int, code: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([book[code[:, j]] for j, book in enumerate(self.books)], axis=1)


@dataclass(frozen=True)
class VectorIndex:
    """lists: ``LISTS`` in the shared folder; slices: of each cell; reach: greatest distance of a row from its cell's centre."""

    base: DataFrame
    lists: DataFrame
    quantizer: Quantizer | None
    slices: np.ndarray
    reach: np.ndarray
    rows: int

    @classmethod
    def build(cls, base: DataFrame, id_col: str, vector_col: str, cells: int | None = None, sample: int = 20_000, seed: int = 42) -> VectorIndex:
        """Index all rows of ``base``; rows whose vector is null, holds a null or NaN, or has another length than the first are in no list.

        ``cells`` is the square root of the rows unless given, an eighth of the sample
        at most; the sample, ``sample`` rows by hash of the id, and the fitted centres
        are all that the driver holds.
        """
        spark = base.sparkSession
        vectors = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x))")
        one = vectors.where("size(v) > 0").orderBy("id").select(F.size("v")).first()
        if one is None:
            return cls(vectors, spark.createDataFrame([], LISTS), None, np.zeros(0, int), np.zeros(0), 0)
        vectors = vectors.where(F.size("v") == one[0])
        rows = vectors.count()
        some = np.array([r[0] for r in vectors.orderBy(F.xxhash64("id")).limit(sample).select("v").collect()])
        q = Quantizer.fit(some, max(1, min(cells or math.isqrt(rows), len(some) // 8)), seed)

        def encode(batches):
            for batch in batches:
                x = _matrix(batch.column(1))
                if not len(x):
                    continue
                cell, code, error = q.encode(x)
                reach = np.sqrt(((x - q.centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(reach)], ["cell", "id", "code", "error", "reach"])

        path = scratch(spark, "vector-lists")
        vectors.mapInArrow(encode, "cell int, id long, code binary, error double, reach double").write.parquet(path)
        lists = spark.read.parquet(path)
        slices, reach = np.ones(len(q.centres), int), np.zeros(len(q.centres))
        for cell, n, far in lists.groupBy("cell").agg(F.count(F.lit(1)), F.max("reach")).collect():  # a row a cell
            slices[cell], reach[cell] = -(-n // SLICE_ROWS), far
        parts = F.element_at(F.array(*[F.lit(int(n)) for n in slices]), F.col("cell") + 1)
        return cls(vectors, lists.withColumn("slice", F.pmod(F.xxhash64("id"), parts).cast("int")), q, slices, reach, rows)

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int, rerank: int | None = None, exact: bool = False, exclude_self: bool = True) -> DataFrame:
        """``query_id, id, rank, score``: the k greatest inner products of each query among the rows, ties by smaller id.

        Queries see the lists of ``probes`` cells and fetch the ``rerank`` best codes
        (ten times k unless given).  With ``exact`` that only gives a floor: then all
        lists that reach it are read and all rows fetched that may lie above, so the
        result is that of comparing every pair.  Queries that the index could not hold find nothing.
        """
        candidates, asked = self.candidates(queries, id_col, vector_col, k, probes, rerank or 10 * k, exact, exclude_self)
        return top_k(self._scores(candidates, asked), ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "id", "rank", "score")

    def candidates(self, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int, rerank: int, exact: bool, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
        """``query_id, id`` of the rows to fetch, and the queries, ``query_id, q``."""
        dimension = 0 if self.quantizer is None else self.quantizer.centres.shape[1]
        asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("q"))
        asked = asked.where((F.size("q") == dimension) & F.lit(dimension > 0) & ~F.exists("q", lambda x: x.isNull() | F.isnan(x)))
        first = self._scan(asked.withColumn("floor", F.lit(None).cast("double")), probes, rerank, exclude_self)
        best = top_k(first, ["query_id"], [F.desc("near"), F.col("id")], rerank).select("query_id", "id")
        if not exact:
            return best, asked
        scored = top_k(self._scores(best, asked), ["query_id"], [F.desc("score"), F.col("id")], k)
        floors = scored.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(-math.inf)).alias("floor"))
        certified = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf)))
        return self._scan(certified, None, None, exclude_self).select("query_id", "id"), asked

    def _scores(self, candidates: DataFrame, asked: DataFrame) -> DataFrame:
        return candidates.join(self.base, "id").join(asked, "query_id").select("query_id", "id", dot(F.col("q"), F.col("v")).alias("score"))

    def _scan(self, asked: DataFrame, probes: int | None, rerank: int | None, exclude_self: bool) -> DataFrame:
        """``query_id, id, near`` by code: the ``rerank`` nearest of each slice, or all that may reach the query's floor."""
        if self.quantizer is None:
            return asked.sparkSession.createDataFrame([], "query_id long, id long, near double")
        quantizer, slices, reach = self.quantizer, self.slices, self.reach
        visits = len(slices) if probes is None else min(probes, len(slices))
        blocks = max(1, -(-asked.count() * visits // (len(slices) * QUERY_ROWS)))

        def route(batches):
            for batch in batches:
                x = _matrix(batch.column(1))
                if not len(x):
                    continue
                near = x @ quantizer.centres.T
                if probes is None:
                    floor = batch.column(2).to_numpy(zero_copy_only=False)
                    row, cell = np.nonzero(near + np.sqrt((x**2).sum(1))[:, None] * reach >= floor[:, None] - 1e-9)
                else:
                    cell = np.argpartition(-near, visits - 1, axis=1)[:, :visits]
                    row, cell = np.repeat(np.arange(len(x)), visits), cell.ravel()
                several = np.repeat(np.arange(len(row)), slices[cell])
                part = np.arange(len(several)) - np.repeat(np.cumsum(slices[cell]) - slices[cell], slices[cell])
                sent = batch.take(pa.array(row[several]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[several].astype(np.int32)), pa.array(part.astype(np.int32)), *sent.columns], ["cell", "slice", "query_id", "q", "floor"])

        routed = asked.select("query_id", "q", "floor").mapInArrow(route, "cell int, slice int, query_id long, q array<double>, floor double").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        lists = self.lists.select("cell", "slice", "id", "code", "error", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

        def scan(key, queries, rows):
            if not queries.num_rows or not rows.num_rows:
                return _found([], [], [])
            code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            x, ids, error = quantizer.decode(key[0].as_py(), code), rows["id"].to_numpy(), rows["error"].to_numpy()
            names, q = queries["query_id"].to_numpy(), _matrix(queries["q"].combine_chunks())
            floor, size = queries["floor"].to_numpy(), np.sqrt((q**2).sum(1))
            out: tuple[list, list, list] = ([], [], [])
            step = max(1, 4_000_000 // len(x))
            for a in range(0, len(q), step):
                near = q[a : a + step] @ x.T
                if exclude_self:
                    near[names[a : a + step, None] == ids] = -np.inf
                if rerank is None:
                    row, at = np.nonzero((near + size[a : a + step, None] * error >= floor[a : a + step, None] - 1e-9) & (near > -np.inf))
                else:
                    at = np.argpartition(-near, min(rerank, len(x)) - 1, axis=1)[:, :rerank].ravel()
                    row = np.repeat(np.arange(len(near)), min(rerank, len(x)))
                    real = near[row, at] > -np.inf
                    row, at = row[real], at[real]
                out[0].append(names[a + row])
                out[1].append(ids[at])
                out[2].append(near[row, at])
            return _found(*out)

        keys = ["cell", "slice", "block"]
        return routed.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInArrow(scan, "query_id long, id long, near double")


def _found(names: list, ids: list, near: list) -> pa.Table:
    whole = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.table([whole(names, pa.int64()), whole(ids, pa.int64()), whole(near, pa.float64())], names=["query_id", "id", "near"])
