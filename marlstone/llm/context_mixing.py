"""Language-model scores by logistic context mixing over bits.

A byte is eight binary decisions.  Five predictors give each its chance of being a
one, from how often it was in the training texts after the same bits of the byte and
the last 0, 1, 3, 4 or 5 bytes.  Their log odds are combined by weights that a gate
selects (which context was seen how often, and the bit's place), and the result is
refined by a map from (gate, chance) to how often such bits were ones.  Weights and
map are learned online: each small batch of bits is predicted first, without the
occurrence itself in the counts, and learned from after.

At scale, all that a text needs is a number for each of its distinct runs of six
bytes.  Parts of the corpus send their distinct runs, with their counts in training
texts, to buckets by a hash of the three bytes before the predicted one, where all
longer contexts lie whole.  Buckets learn weights side by side, which are averaged
by how many bits each gate has judged; then they send the log probability of each
run back.  Counts of words for the base score travel with them.  While documents are
scored the model stays as it is, so a score depends on no order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookup
from .cluster import cut, map_batches, small_batches
from .packing import pack, unpack
from .wordtable import buffers, hashed

#: MB of text in a part; a bucket has what so many parts send.
PART_MB = 16
PARTS_A_BUCKET = 4
#: Bytes of text framed at once, unless one text is longer, and positions worked out at once.
BLOCK_BYTES = 1 << 20
#: Runs of six bytes that a bucket works out at once, and learns from before it predicts on.
CHUNK = 1 << 16
BATCH = 1 << 11

LEAD = 5
#: Never in UTF-8: stands before a text, and ends it.
FRAME = 0xFF
WORD, RUN, PAIR = 1, 2, 3

ORDERS = (0, 1, 3, 4, 5)
INPUTS = len(ORDERS) + 1
GATES = 9
DELTA = 0.4
RATE = 0.15
BINS, LIMIT = 33, 8.0
#: How many bits a bin of the map counts as before it has seen any.
PRIOR = 8.0

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"

U = np.uint64
_MASK = np.uint32(0xFFFFFF)
_MUL = (0x9E3779, 0xC2B2AE | 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)


def spread(x: np.ndarray) -> np.ndarray:
    """A permutation of 24 bits, so that buckets get their share and no contexts are confused."""
    x = x * np.uint32(_MUL[0]) & _MASK
    x ^= x >> np.uint32(12)
    return x * np.uint32(_MUL[1]) & _MASK


def gathered_back(y: np.ndarray) -> np.ndarray:
    y = y * np.uint32(pow(_MUL[1], -1, 1 << 24)) & _MASK
    y ^= y >> np.uint32(12)
    return y * np.uint32(pow(_MUL[0], -1, 1 << 24)) & _MASK


def runs_of(column: pa.Array):
    """Yield (first row, ascending codes with the row less the first in the last 16 bits) over the predicted bytes of texts, the end of each included.

    A code has 48 bits: the last three bytes, spread, the two before, the latest
    first, and the byte itself.  Nulls are empty texts.
    """
    data, doc = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = min(rows, row + 60_000, max(row + 1, int(np.searchsorted(doc, doc[row] + BLOCK_BYTES, side="right")) - 1))
        size = np.diff(doc[row : stop + 1])
        starts = np.concatenate(([0], np.cumsum(size + LEAD + 1)))
        framed = np.full(int(starts[-1]), FRAME, np.uint8)
        if stop == row + 1:
            framed[LEAD : LEAD + size[0]] = data[doc[row] : doc[stop]]
        else:
            framed[np.arange(int(size.sum())) + np.repeat(starts[:-1] + LEAD - (doc[row:stop] - doc[row]), size)] = data[doc[row] : doc[stop]]
        for a in range(0, len(framed), BLOCK_BYTES):
            b = min(a + BLOCK_BYTES, len(framed))
            yield row, _codes(framed, a, b, starts)
        row = stop


def _codes(framed: np.ndarray, a: int, b: int, starts: np.ndarray) -> np.ndarray:
    first = int(np.searchsorted(starts, a, side="right")) - 1
    new = starts[first + 1 : int(np.searchsorted(starts, b))]
    mark = np.zeros(b - a, np.int64)
    mark[new - a] = 1
    of = first + np.cumsum(mark)
    at = np.flatnonzero(np.arange(a, b) - starts[of] >= LEAD)
    of, at = of[at], at + a
    c = [framed[at - k].astype(np.uint32) for k in range(LEAD, 0, -1)]
    near = spread(c[2] << np.uint32(16) | c[3] << np.uint32(8) | c[4]).astype(U)
    code = near << U(40) | (c[1] << np.uint32(8) | c[0]).astype(U) << U(24) | framed[at].astype(U) << U(16)
    return np.sort(code | of.astype(U))


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _lower(column: pa.Array) -> pa.Array:
    """A string column with A-Z in lower case, without nulls."""
    data, doc = buffers(column)
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(doc.astype(np.int64).tobytes()), pa.py_buffer(LOWER[data].tobytes())])


class Part:
    """The texts of a part: distinct runs and words, with their counts in training texts."""

    def __init__(self, table: pa.Table):
        self.table = table
        column = table["text"].cast(pa.large_string()).combine_chunks()
        self.text = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column if isinstance(column, pa.Array) else pa.array([], pa.large_string())
        self.held_out = table["held_out"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        self.hashes, self.offsets = hashed(_lower(self.text))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        known = np.sort(self.hashes)
        known = known[_starts(known)]
        learned = np.sort(self.hashes[np.repeat(~self.held_out, np.diff(self.offsets))])
        at = _starts(learned)
        count = np.zeros(len(known), np.int64)
        count[np.searchsorted(known, learned[at])] = np.diff(np.append(at, len(learned)))
        return known, count

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs, their counts, and the counts of (byte, byte after it), all in training texts."""
        codes, counts, waiting = np.zeros(0, U), np.zeros(0, np.int64), []
        pairs = np.zeros(1 << 16, np.int64)
        for row, packed in runs_of(self.text):
            learned = ~self.held_out[row + (packed & U(0xFFFF)).astype(np.int64)]
            code = packed >> U(16)
            at = _starts(code)
            n = np.add.reduceat(learned.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            waiting.append((code[at], n))
            if sum(len(c) for c, _ in waiting) > max(1 << 20, len(codes)):
                codes, counts, waiting = *_merged([(codes, counts), *waiting]), []
        codes, counts = _merged([(codes, counts), *waiting])
        last, byte = _last_byte(codes), (codes & U(0xFF)).astype(np.int64)
        pairs += np.bincount(last << 8 | byte, weights=counts, minlength=1 << 16).astype(np.int64)
        return codes << U(16), counts, pairs

    def messages(self, part: int, level: lookup.Level):
        yield from lookup.messages(WORD, part, *self.words(), level)
        codes, counts, pairs = self.runs()
        yield from lookup.messages(RUN, part, codes, counts, level)
        has = np.flatnonzero(pairs)
        yield PAIR, part, 0, len(has), pack(has.astype(U), pairs[has])

    def result(self, replies: pa.Table, level: lookup.Level, base: Base) -> pa.Table:
        rows = len(self.text)
        known, _ = self.words()
        count = lookup.answers(known, lookup.replies(replies, WORD), level, np.int64)
        seen = count[np.searchsorted(known, self.hashes)]
        doc = np.repeat(np.arange(rows), np.diff(self.offsets))
        n = np.diff(self.offsets) + 1
        n_known = np.bincount(doc, weights=seen > 0, minlength=rows).astype(np.int64) + (base.ends > 0)
        logs = np.bincount(doc, weights=np.log10(seen + 1.0), minlength=rows) + math.log10(base.ends + 1)
        codes, _, _ = self.runs()
        value = lookup.answers(codes, lookup.replies(replies, RUN), level, np.float32)
        score = np.zeros(rows)
        for row, packed in runs_of(self.text):
            code = packed & ~U(0xFFFF)
            at = _starts(code)
            each = np.repeat(value[np.searchsorted(codes, code[at])].astype(np.float64), np.diff(np.append(at, len(code))))
            sums = np.bincount((packed & U(0xFFFF)).astype(np.int64), weights=each)
            score[row : row + len(sums)] += sums
        size = np.diff(buffers(self.text)[1])
        bits = np.where(size > 0, -score * math.log2(10) / np.maximum(size, 1), 0.0)
        columns = [self.table["doc_id"], self.table["held_out"], pa.array(n), pa.array(n_known), pa.array(np.full(rows, base.tokens)), pa.array(logs - n * math.log10(base.tokens + base.distinct + 1)), pa.array(score), pa.array(size), pa.array(bits)]
        return pa.table(columns, names=RESULT.replace(",", "").split()[::2])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return lookup.distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _last_byte(codes: np.ndarray) -> np.ndarray:
    return (gathered_back((codes >> U(24)).astype(np.uint32)) & np.uint32(0xFF)).astype(np.int64)


@dataclass(frozen=True)
class Base:
    """What the base score needs of the training texts: documents, tokens and distinct tokens, ends included."""

    ends: int
    tokens: int
    distinct: int


@dataclass(frozen=True)
class Mixer:
    """pairs: counts of bytes after a byte (256 by 256); weights: by gate and bit, then input; refined: by gate and bin of log odds."""

    pairs: np.ndarray
    weights: np.ndarray
    refined: np.ndarray

    def log10(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the chance of the last byte of each run; codes: all runs of some buckets, counts: in training texts."""
        out = np.zeros(len(codes))
        tree = Tree(codes, counts, self.pairs)
        for a in range(0, len(codes), CHUNK):
            ones, zeros, bit = tree.counts(a, min(a + CHUNK, len(codes)))
            x, gate = inputs(ones, zeros)
            mixed = np.clip((x * self.weights[gate]).sum(-1), -LIMIT, LIMIT)
            p = refine(mixed, gate // 8, self.refined)
            out[a : a + CHUNK] = np.log10(np.where(bit, p, 1 - p)).sum(1)
        return out


class Tree:
    """Counts of all bits after all contexts of a bucket: sorted runs, a context of any order being a range of them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        self.byte = (codes & U(0xFF)).astype(np.int64)
        self.last = _last_byte(codes)
        self.pairs = np.concatenate((np.zeros((256, 1), np.int64), np.cumsum(pairs, axis=1)), axis=1)
        self.single = np.concatenate(([0], np.cumsum(pairs.sum(axis=0))))
        self.orders = []
        for order in ORDERS[2:]:
            own = (codes >> U(8 * (LEAD + 1 - order))) << U(8) | codes & U(0xFF)
            keys, n = lookup.distinct(own, counts)
            self.orders.append((own & ~U(0xFF), keys, np.concatenate(([0], np.cumsum(n)))))

    def counts(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ones and zeros (run, bit, order) after the bits before, and the bits (run, bit)."""
        byte, last = self.byte[a:b], self.last[a:b]
        ones, zeros = (np.zeros((b - a, 8, len(ORDERS)), np.int64) for _ in range(2))
        bits = (byte[:, None] >> np.arange(7, -1, -1) & 1).astype(bool)
        upto = [lambda at: self.single[at], lambda at: self.pairs[last, at]]
        for own, keys, total in self.orders:
            upto.append(lambda at, own=own[a:b], keys=keys, total=total: total[np.searchsorted(keys, own + at.astype(U))])
        for k, below in enumerate(upto):
            low = np.zeros(b - a, np.int64)
            at_low, at_high = below(low), below(low + 256)
            for j in range(8):
                middle = low + (128 >> j)
                at_middle = below(middle)
                ones[:, j, k], zeros[:, j, k] = at_high - at_middle, at_middle - at_low
                low = np.where(bits[:, j], middle, low)
                at_low, at_high = np.where(bits[:, j], at_middle, at_low), np.where(bits[:, j], at_high, at_middle)
        return ones, zeros, bits


def inputs(ones: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds by order and a constant (run, bit, input), and the gate times 8 plus the bit."""
    x = np.empty((*ones.shape[:2], INPUTS))
    x[..., :-1] = np.log((ones + DELTA) / (zeros + DELTA))
    x[..., -1] = 0.3
    n3, n4, n5 = (ones[..., k] + zeros[..., k] for k in (2, 3, 4))
    gate = np.select([n5 >= 10, n5 >= 3, n5 >= 1, n4 >= 3, n4 >= 1, n3 >= 10, n3 >= 3, n3 >= 1], range(8), 8)
    return x, gate * 8 + np.arange(8)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _bins(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin below, and how near the next one is."""
    at = (mixed + LIMIT) * ((BINS - 1) / (2 * LIMIT))
    low = np.minimum(at.astype(np.int64), BINS - 2)
    return low, at - low


def refine(mixed: np.ndarray, gate: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The chance of a one: the mean of the mixed one and of what the map has for it."""
    low, part = _bins(mixed)
    return 0.5 * _squash(mixed) + 0.5 * ((1 - part) * table[gate, low] + part * table[gate, low + 1])


def first_weights() -> np.ndarray:
    out = np.full((GATES * 8, INPUTS), 0.3)
    out[:, -1] = 0
    return out


def learn(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights after one pass over the runs of a bucket, how many bits each gate and place judged, and ones and all bits by gate and bin."""
    weights, squares = first_weights(), np.full((GATES * 8, INPUTS), 1e-3)
    judged, ones_in, all_in = np.zeros(GATES * 8), np.zeros(GATES * BINS), np.zeros(GATES * BINS)
    tree = Tree(codes, counts, pairs)
    for a in range(0, len(codes), BATCH):
        b = min(a + BATCH, len(codes))
        n = counts[a:b].astype(np.float64)
        has = n > 0
        if not has.any():
            continue
        ones, zeros, bit = (z[has] for z in tree.counts(a, b))
        # The occurrence that is predicted is not among those that predict it.
        x, gate = inputs(ones - bit[..., None], zeros - ~bit[..., None])
        mixed = np.clip((x * weights[gate]).sum(-1), -LIMIT, LIMIT)
        weight = np.broadcast_to(n[has, None], bit.shape)
        error = (bit - _squash(mixed)) * weight
        seen = np.bincount(gate.ravel(), weights=weight.ravel(), minlength=GATES * 8)
        judged += seen
        low, part = _bins(mixed)
        for at, share in ((low, 1 - part), (low + 1, part)):
            cell = (gate // 8 * BINS + at).ravel()
            all_in += np.bincount(cell, weights=(share * weight).ravel(), minlength=GATES * BINS)
            ones_in += np.bincount(cell, weights=(share * weight * bit).ravel(), minlength=GATES * BINS)
        step = np.stack([np.bincount(gate.ravel(), weights=(error * x[..., k]).ravel(), minlength=GATES * 8) for k in range(INPUTS)], axis=1) / np.maximum(seen, 1)[:, None]
        squares += step**2
        weights += RATE * step / np.sqrt(squares)
    return weights, judged, ones_in, all_in


def _sums(rows: DataFrame) -> dict[int, tuple[float, float]]:
    return {r["place"]: (r["a"], r["b"]) for r in rows.groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}


def fit(sent: DataFrame, parts: int, level: lookup.Level, ends: int) -> tuple[Base, Mixer]:
    """The model from the messages of all parts.  The driver gets sums of a fixed number: pairs of bytes, weights by gate, bins."""

    def unpacked(batches):
        for batch in batches:
            for n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = unpack(body, n, U, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["pair", "count"])

    pairs = np.zeros(1 << 16, np.int64)
    for pair, n in map_batches(sent.where(F.col("kind") == PAIR).select("n", "body"), unpacked, "pair long, count long").groupBy("pair").agg(F.sum("count")).collect():
        pairs[pair] = n
    pairs = pairs.reshape(256, 256)
    n_weights, n_bins = GATES * 8 * INPUTS, GATES * BINS

    def totals(table: pa.Table) -> pa.Table:
        words = lookup.Gathered(WORD, table)
        runs = lookup.Gathered(RUN, table)
        weights, judged, ones, bits = learn(runs.keys >> U(16), runs.numbers, pairs)
        by_input = np.repeat(judged, INPUTS)
        a = np.concatenate(((weights.ravel() * by_input), ones, [words.numbers.sum()]))
        b = np.concatenate((by_input, bits, [(words.numbers > 0).sum()]))
        return pa.table([pa.array(np.arange(len(a))), pa.array(a), pa.array(b)], names=["place", "a", "b"])

    arrived = lookup.arrived(sent.where(F.col("kind") != PAIR), parts, level, (WORD, RUN))
    sums = _sums(arrived.groupBy("bucket").applyInArrow(totals, "place long, a double, b double"))
    a, b = (np.array([sums.get(k, (0.0, 0.0))[i] for k in range(n_weights + n_bins + 1)]) for i in (0, 1))
    weights = np.where(b[:n_weights] > 0, a[:n_weights] / np.maximum(b[:n_weights], 1e-9), first_weights().ravel()).reshape(-1, INPUTS)
    prior = np.broadcast_to(_squash(np.linspace(-LIMIT, LIMIT, BINS)), (GATES, BINS)).ravel()
    refined = (a[n_weights:-1] + PRIOR * prior) / (b[n_weights:-1] + PRIOR)
    base = Base(ends, int(a[-1]) + ends, int(b[-1]) + (ends > 0))
    # Sums of doubles come in any order: the last places are dropped.
    return base, Mixer(pairs, weights.round(9), refined.reshape(GATES, BINS).round(9))


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, part_mb: float = PART_MB) -> DataFrame:
    """Base and model scores of every document: ``RESULT``.

    docs: ``doc_id, text``, other columns are ignored.  Tokens of the base are words
    (runs of bytes other than x20 and x09-x0D, A-Z in lower case), then one end.  The
    score is log10 of the chance of the text's bytes and of its end there;
    ``bits_per_byte`` is that by byte (0 for an empty text).  A null or empty text is
    its end alone; a null id is learned from; repeated rows count each and are placed
    together; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 1), F.lit(0)), F.count(F.when(~F.col("held_out"), 1))).first()
    parts = max(1, math.ceil(size / (part_mb * 1e6)))
    level = lookup.Level.first(-(-parts // PARTS_A_BUCKET))
    by_part = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("long")).groupBy("part")

    def announce(key, table):
        return lookup.as_table(Part(table).messages(key[0].as_py(), level))

    small_batches(docs.sparkSession)
    sent = cut(by_part.applyInArrow(announce, lookup.MESSAGE))
    base, mixer = fit(sent, parts, level, ends)
    answer = {WORD: lambda keys, counts: counts, RUN: lambda keys, counts: mixer.log10(keys >> U(16), counts)}
    replies = lookup.exchange(sent.where(F.col("kind") != PAIR), parts, level, answer, {WORD: np.int64, RUN: np.float32})

    def finish(key, table, replied):
        return Part(table).result(replied, level, base)

    return by_part.cogroup(replies.groupBy("part")).applyInArrow(finish, RESULT)
