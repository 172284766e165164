"""Importance resampling towards a target: word tries, bucket gains, Gumbel top k.

Features of a text are its runs of one to three words.  A task builds a trie over
the words of a block of its texts, level by level: a node holds how often its path
occurs and the CRC of the path's bytes, which goes on from the state of its parent.
Counts are summed by CRC bucket over all tasks.  The second pass builds the same
tries with the gain of each node's bucket attached, and adds up gains along the
paths of every document.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, map_batches, small_batches, tidy
from .wordtable import IS_SPACE, buffers, cuts, word_hash, words

BUCKETS = 10_000
ORDER = 3
LEAST_WORDS = 20
#: Bytes of text in a trie.
BLOCK_BYTES = 2 << 20

#: Lower case for A-Z, and a space for every byte that is in no word.
FOLD = np.full(256, 0x20, np.uint8)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    FOLD[_c] = _c
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _zeros_operator() -> list[np.ndarray]:
    """For each k, tables (4 by 256) that take a CRC state over 2**k zero bytes: appending bytes is linear in the state."""
    single = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)], np.uint32)
    out = []
    for _ in range(32):
        table = np.zeros((4, 256), np.uint32)
        for i in range(32):
            has = (np.arange(256) >> (i % 8)) & 1 == 1
            table[i // 8, has] ^= single[i]
        out.append(table)
        single = _apply(table, single)
    return out


def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 255] ^ table[1][(state >> 8) & 255] ^ table[2][(state >> 16) & 255] ^ table[3][state >> 24]


_ZEROS = _zeros_operator()


def extended(state: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of byte strings with CRC ``state`` after bytes with CRC ``tail`` and length ``size`` were appended."""
    state, k = state.astype(np.uint32), 0
    while (size >> k).any():
        at = np.flatnonzero((size >> k) & 1)
        state[at] = _apply(_ZEROS[k], state[at])
        k += 1
    return state ^ tail


class Trie:
    """Paths of up to ``ORDER`` words over a block.

    data: folded bytes; start, end: of words; doc: of each word, ascending.  The first
    ``lead`` words are known from the block before: paths that end there are not
    counted.  By level: ``node`` of the path that ends at each word (-1 if there is
    none), ``count`` and ``crc`` of each node.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, lead: int = 0):
        self.node: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.crc: list[np.ndarray] = []
        _, first, child = np.unique(word_hash(data, start, end), return_index=True, return_inverse=True)
        spelt = [data[a:b].tobytes() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        size = (end - start)[first] + 1
        tail = np.fromiter((zlib.crc32(b" " + w) for w in spelt), np.uint32, len(spelt))
        self._level(child, len(first), lead, np.fromiter(map(zlib.crc32, spelt), np.uint32, len(spelt)))
        for depth in range(1, ORDER):
            node = np.full(len(child), -1, np.int64)
            held = np.flatnonzero(doc[depth:] == doc[: len(doc) - depth]) + depth
            key = (self.node[-1][held - 1] << 32) | child[held]
            paths, inverse = np.unique(key, return_inverse=True)
            node[held] = inverse
            word = paths & 0xFFFFFFFF
            self._level(node, len(paths), lead, extended(self.crc[-1][paths >> 32], tail[word], size[word]))

    def _level(self, node: np.ndarray, n: int, lead: int, crc: np.ndarray) -> None:
        self.node.append(node.astype(np.int64))
        ends = node[lead:]
        self.count.append(np.bincount(ends[ends >= 0], minlength=n))
        self.crc.append(crc)

    def totals(self) -> np.ndarray:
        """How many paths fall into each bucket."""
        return sum(np.bincount(crc % BUCKETS, weights=count, minlength=BUCKETS) for crc, count in zip(self.crc, self.count, strict=True)).astype(np.int64)

    def gains(self, gain: np.ndarray) -> np.ndarray:
        """Sum of the gains of the paths that end at each word."""
        out = np.zeros(len(self.node[0]), np.int64)
        for node, crc in zip(self.node, self.crc, strict=True):
            attached = np.append(gain[crc % BUCKETS], 0)  # the last for no node
            out += attached[node]
        return out


def blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """Yield (first row, rows, trie, row of each of its words, words known from before) over runs of whole texts, or over pieces of a long one."""
    raw, doc = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = min(rows, max(row + 1, int(np.searchsorted(doc, doc[row] + most, side="right")) - 1))
        run = FOLD[raw[doc[row] : doc[stop]]]
        if stop > row + 1 or len(run) <= most:
            t = words(run, doc[row : stop + 1] - doc[row])
            yield row, stop - row, Trie(run, t.start, t.end, t.doc_of_word), t.doc_of_word, 0
        else:
            known = b""
            at = cuts(run, most, IS_SPACE)
            for a, b in zip(at[:-1], at[1:], strict=True):
                piece = np.concatenate((np.frombuffer(known, np.uint8), run[a:b]))
                t = words(piece, np.array([0, len(piece)]))
                lead = len(known.split())
                yield row, 1, Trie(piece, t.start, t.end, t.doc_of_word, lead), t.doc_of_word, lead
                known = b"".join(t.word(i) + b" " for i in range(max(0, len(t.start) - ORDER + 1), len(t.start)))
        row = stop


def bucket_totals(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket: a task sends one row for each bucket it has, the driver gets ``BUCKETS`` at most."""

    @tidy
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, trie, _, _ in blocks(batch.column(0)):
                total += trie.totals()
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    rows = map_batches(texts.select("text"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket, in doubles."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_source / ((float(s) + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""

    @tidy
    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            n, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for row, some, trie, doc, lead in blocks(batch.column(1)):
                n[row : row + some] += np.bincount(doc[lead:], minlength=some)
                # Gains are below 2**20 in size, so that sums are exact in doubles.
                weight[row : row + some] += np.bincount(doc[lead:], weights=trie.gains(gain)[lead:], minlength=some).astype(np.int64)
            features = sum(np.maximum(n - k, 0) for k in range(ORDER))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document.

    Words are runs of bytes other than x00-x2F, x3A-x60 and x7B-x7F, A-Z in lower
    case.  The score is the weight plus Gumbel noise from a digest of seed and id (a
    null id counts as no characters); of the N documents of ``least_words`` words the
    floor(percent N / 100) of the highest scores are drawn without replacement and
    ranked, ties by smaller id (null last), then by weight and features.  Others have no rank.

    docs: ``doc_id, text``; target: ``text``; other columns are ignored.  A null or
    empty text has no features and weight 0, repeated rows are drawn one by one, an
    empty table gives an empty one, an empty target a flat one.  Long texts are
    worked out in pieces.
    """
    gain = bucket_gains(bucket_totals(docs), bucket_totals(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = weigh(docs, gain).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    scored = cut(scored)  # the order samples its rows before it deals them
    # A global order without a single task: ranges are sorted, kept, counted, and a row's place in its range is added to the rows before.
    ordered = cut(scored.orderBy(F.desc("able"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.desc("weight"), F.desc("n_features")))
    placed = ordered.withColumns({"__range": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("able"), 1)).alias("able")).orderBy("__range").collect()
    drawn = sum(r["able"] for r in sizes) * percent // 100
    before = F.create_map(*[F.lit(x) for r, n in zip(sizes, np.cumsum([0, *[r["n"] for r in sizes]])[:-1].tolist(), strict=True) for x in (r["__range"], n)]) if sizes else F.create_map().cast("map<int,bigint>")
    rank = (before[F.col("__range")] + F.col("__row") + 1).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank"))
