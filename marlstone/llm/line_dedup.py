"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity in the corpus, and a
line is indexed under the first few (its prefix), so that two lines of a Jaccard
similarity of at least the threshold meet under some word.  Pairs that meet pass
the length filter, the positional filter (how many words can still be shared after
this position) and a parity filter (64 bits, for long lines 256, one flipped by
each word: bits that differ are words not shared).  What is left is verified on the whole sets.  A line
that is similar to an earlier one goes.

Rarity comes from a table of word counts of fixed size.  Words that share a counter
share its rank and are told apart by their hash, so the order is total and the
join exact whatever the table's size; only speed depends on it.

No bucket emits all pairs of a group of near copies: a line proposes its nearest
earlier candidates.  Should all of a line's proposals fail although it had others,
a second round looks for one match among all, again without emitting pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, map_batches, release, small_batches, tidy
from .packing import pack, unpack
from .wordtable import IS_SPACE, NEWLINE, Words, chunks, mix, order_by

THRESHOLD = 0.8
RANK_BITS = 18
SKETCH_CHUNKS = 16
#: Words of the input for a bucket, on average; a task holds one bucket at a time.
BUCKET_WORDS = 2_600_000
#: A task sends entries to up to so many receivers, as a power of two; with more buckets, nodes in between gather and pass on.
FAN_BITS = 11
#: Size up to which the affected documents and their lines are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: A pair whose parity bits differ in at most this share of what the threshold allows is taken for a match until verified.
SURE = 0.5
#: Words with more entries than HOT_ENTRIES, by one document in HOT_SHARE, are dealt in blocks of BLOCK_ENTRIES; each two blocks are a bucket.
HOT_SHARE, HOT_ENTRIES, BLOCK_ENTRIES = 64, 2_000_000, 1_000_000
NEAREST = 12
#: Candidates after which a line with a sure one among them looks no further.
ENOUGH = 24
#: Entries that a task packs at once.
INDEX_ROWS = 400_000
LAST = np.iinfo(np.int64).max
EPS = 1e-9

PLACE = "doc long, line int, hash long"
FULL = "word long, doc long, line int, hash long, size long, p0 long, p1 long, p2 long, p3 long, words array<long>"
PROPOSAL = "b struct<doc: long, line: int, hash: long>, a struct<doc: long, line: int, hash: long>, equal boolean, sure boolean, more boolean, distance int"
_PLACE = pa.struct([("doc", pa.int64()), ("line", pa.int32()), ("hash", pa.int64())])


def overlap(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """Fewest shared words for a similarity of t of sets of n and m words."""
    return np.ceil(t / (1 + t) * (n + m) - EPS).astype(np.int64)


def prefix(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - EPS).astype(np.int64) + 1


# Rarity


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, held, n = np.zeros(1 << RANK_BITS, np.int64), [], 0
    for batch in batches:
        for _, _, t in chunks(batch.column(0), cut_at=IS_SPACE):
            held.append((t.word_hashes() & np.uint64((1 << RANK_BITS) - 1)).astype(np.int32))
            n += len(held[-1])
            if n > 1 << 20:
                table += np.bincount(np.concatenate(held), minlength=len(table))
                held, n = [], 0
    if held:
        table += np.bincount(np.concatenate(held), minlength=len(table))
    yield _chunks_of(table, range(SKETCH_CHUNKS))


def _chunks_of(table: np.ndarray, which) -> pa.RecordBatch:
    parts = table.reshape(SKETCH_CHUNKS, -1)
    which = list(which)
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([pack(np.zeros(0, np.uint8), parts[i]) for i in which], pa.binary())], names=["chunk", "body"])


@tidy
def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = (1 << RANK_BITS) // SKETCH_CHUNKS
    table, seen = np.zeros((SKETCH_CHUNKS, width), np.int64), set()
    for batch in batches:
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table[i] += _counts(body)
            seen.add(i)
    yield _chunks_of(table.reshape(-1), sorted(seen))


def _counts(body: bytes) -> np.ndarray:
    raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Rank of each counter by its words' count over all documents, 2 ** RANK_BITS ranks, whatever the input's size; and the number of words."""
    counted = docs.select("text").mapInArrow(_count, "chunk int, body binary")
    # Two steps, so that no task reads the tables of all others.
    half = counted.withColumn("side", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("chunk", "side").select("chunk", "body")
    summed = half.mapInArrow(_add, "chunk int, body binary").repartition(SKETCH_CHUNKS, "chunk").mapInArrow(_add, "chunk int, body binary").collect()
    table = np.zeros((SKETCH_CHUNKS, (1 << RANK_BITS) // SKETCH_CHUNKS), np.int64)
    for r in summed:
        table[r["chunk"]] += _counts(bytes(r["body"]))
    rank = np.empty(1 << RANK_BITS, np.uint64)
    rank[np.argsort(table.reshape(-1), kind="stable")] = np.arange(1 << RANK_BITS, dtype=np.uint64)
    return rank, int(table.sum())


# Lines


class Lines:
    """Word sets of the lines of a run of documents; ``keys`` ascend by rarity inside a line."""

    def __init__(self, t: Words, rank: np.ndarray, only: np.ndarray | None = None, base: int = 0):
        """only: flags of ``slots``, lines without a word of one are left out; base: lines before a piece of a text."""
        h = t.word_hashes()
        breaks = np.flatnonzero(t.data == 10)
        # A line number over all documents: newlines before it, and one more for each document's end.
        at = np.searchsorted(breaks, t.start) + t.doc_of_word
        key = (rank[(h & np.uint64((1 << RANK_BITS) - 1)).astype(np.int64)] << np.uint64(64 - RANK_BITS)) | (h >> np.uint64(RANK_BITS))
        if only is not None:
            wanted = np.zeros(int(at[-1]) + 1 if len(at) else 0, bool)
            wanted[at[only[slots(key)]]] = True
            near = wanted[at]
            at, key, h = at[near], key[near], h[near]
        order = order_by(at, key)
        at, key = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
        at, self.keys, word = at[new], key[new], mix(h[order][new])
        self.first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        self.end = np.append(self.first[1:], len(at)) if len(at) else self.first
        self.size = self.end - self.first
        number = at[self.first] if len(at) else np.zeros(0, np.int64)
        head = np.searchsorted(breaks, t.doc[:-1]) + np.arange(len(t.doc) - 1)  # number of each document's first line
        self.doc = np.searchsorted(head, number, side="right") - 1
        self.line = (number - head[self.doc] + base).astype(np.int32)
        self.hash, self.parity, self.wide = np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros((3, 0), np.uint64)
        if len(at):
            self.hash = (mix(np.add.reduceat(word, self.first)) >> np.uint64(32)).astype(np.uint32)
            bit, part = np.uint64(1) << (word & np.uint64(63)), (word >> np.uint64(6)) & np.uint64(3)
            self.parity = np.bitwise_xor.reduceat(bit, self.first)
            self.wide = np.zeros((3, len(self.size)), np.uint64)
            self.wide[0] = mix(np.add.reduceat(word * (word >> np.uint64(29) | np.uint64(1)), self.first))
            long = np.flatnonzero(self.size > LONG)
            if len(long):
                rows = np.repeat(self.first[long] - (np.cumsum(self.size[long]) - self.size[long]), self.size[long]) + np.arange(int(self.size[long].sum()))
                starts = np.cumsum(self.size[long]) - self.size[long]
                for k in (1, 2, 3):
                    self.wide[k - 1, long] = np.bitwise_xor.reduceat(np.where(part[rows] == k, bit[rows], np.uint64(0)), starts)


def tables(column: pa.Array) -> Iterator[tuple[int, int, Words, int]]:
    """First row, last row + 1, words, and lines before: long texts come in pieces of whole lines."""
    base = 0
    for a, b, t in chunks(column, cut_at=NEWLINE):
        base = base if t.before else 0
        yield a, b, t, base
        base += int(np.count_nonzero(t.data == 10)) if t.after else 0


#: Size of the table of flags that says under which words the second round looks.
SLOT_BITS = 24


def slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


#: Lines of more words than this carry 256 parity bits: three parts beside ``parity``, which is all four folded.
#: Shorter ones have a second hash of their set in the place of the first part, 64 bits, of which 32 are sent with all but the rarest word.
LONG = 96
#: key, pos, size, parity, hash, doc, line, and the parts of a long line's parity.
ENTRY = (np.uint32, np.uint16, np.uint32, np.uint64, np.uint32, np.int64, np.int32, np.uint64, np.uint64, np.uint64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False)


def _spread(keys: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix(keys)
    return (m & np.uint64((1 << bucket_bits) - 1)).astype(np.int64), (m >> np.uint64(32)).astype(np.uint32)


def _entries(ids: np.ndarray, lines: Lines, t: float, bucket_bits: int, rows: np.ndarray | None = None) -> list[np.ndarray]:
    """Bucket, entry columns, row in ``lines`` and key of the prefixes of lines; copies inside the run keep the first word only."""
    rows = np.arange(len(lines.size)) if rows is None else rows
    doc = ids[lines.doc[rows]]
    order = np.lexsort((lines.line[rows], doc, lines.wide[0, rows], lines.parity[rows], lines.hash[rows], lines.size[rows]))
    r = rows[order]
    copy = np.zeros(len(r), bool)
    copy[1:] = True
    for x in (lines.hash, lines.parity, lines.size, lines.wide[0]):
        copy[1:] &= x[r[1:]] == x[r[:-1]]
    count = np.where(copy, np.minimum(1, lines.size[r]), prefix(lines.size[r], t))
    line = np.repeat(r, count)
    pos = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    word = lines.keys[lines.first[line] + pos]
    bucket, key = _spread(word, bucket_bits)
    wide = lines.wide[:, line]
    wide[0, (pos > 0) & (lines.size[line] <= LONG)] &= np.uint64(0xFFFFFFFF)
    return [bucket, key, np.minimum(pos, 65535).astype(np.uint16), lines.size[line].astype(np.uint32), lines.parity[line], lines.hash[line], ids[lines.doc[line]], lines.line[line], *wide, line, word]


@dataclass(frozen=True)
class Hot:
    """words: ascending keys of the words that are dealt; blocks: how many each has."""

    words: np.ndarray
    blocks: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        """Blocks of each word, 1 for one that is not dealt."""
        if not len(self.words):
            return np.ones(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.blocks[at], 1)


#: Sides of the entries of a bucket of two blocks are 0 and 1; this is that of a block's own bucket.
WITHIN = 2


def _block(sethash: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (mix(sethash.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)


def _deal(entries: list[np.ndarray], hot: Hot) -> list[np.ndarray]:
    """Entries of hot words once for each bucket of two blocks that their block is in; those buckets have negative numbers."""
    word = entries[-1]
    blocks = hot.of(word)
    if not (blocks > 1).any():
        return entries
    copy = np.repeat(np.arange(len(word)), blocks)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    out = [c[copy] for c in entries]
    mine, many = _block(entries[5], blocks)[copy], blocks[copy] > 1
    pair = (np.minimum(mine, other) << 32) | np.maximum(mine, other)
    out[0] = np.where(many, -1 - (mix(mix(out[-1]) ^ pair.astype(np.uint64)) >> np.uint64(1)).astype(np.int64), out[0])
    side = np.where(mine == other, WITHIN, mine > other).astype(np.uint32)
    out[1] = np.where(many, side, out[1])
    return out


@tidy
def _prefixes(batches: Iterator[pa.RecordBatch], rank_of, t: float) -> Iterator[pa.RecordBatch]:
    """Entries of each word in a run of documents, counted."""
    rank = rank_of()
    for batch in batches:
        ids = _ids(batch.column(0))
        for a, b, table, base in tables(batch.column(1)):
            words, n = np.unique(_entries(ids[a:b], Lines(table, rank, base=base), t, 0)[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def hot_words(docs: DataFrame, rank_of, t: float) -> Hot:
    """Words under which too many lines meet for one task, by a share of the documents; how lines are dealt does not change what is found."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(HOT_SHARE)) == 0)
    counts = some.mapInArrow(partial(_prefixes, rank_of=rank_of, t=t), "word long, n long").groupBy("word").agg((F.sum("n") * HOT_SHARE).alias("n"))
    rows = sorted((r["word"] & 0xFFFFFFFFFFFFFFFF, -(-r["n"] // BLOCK_ENTRIES)) for r in counts.where(F.col("n") > HOT_ENTRIES).collect())  # at most a row for HOT_ENTRIES entries
    return Hot(np.array([w for w, _ in rows], np.uint64), np.array([n for _, n in rows], np.int64))


@tidy
def _index(batches: Iterator[pa.RecordBatch], rank_of, t: float, bucket_bits: int, hot_of) -> Iterator[pa.RecordBatch]:
    """Packed entries for each receiver: a bucket, or with many of them a range of buckets."""
    rank, hot, held, n = rank_of(), hot_of(), [], 0
    shift = max(0, bucket_bits - FAN_BITS)
    for batch in batches:
        ids = _ids(batch.column(0))
        for a, b, table, base in tables(batch.column(1)):
            held.append(_deal(_entries(ids[a:b], Lines(table, rank, base=base), t, bucket_bits), hot)[:-2])
            n += len(held[-1][0])
            if n >= INDEX_ROWS:
                yield from _pack_entries(held, shift)
                held, n = [], 0
    yield from _pack_entries(held, shift)


def _passing(shift: int):
    def run(table: pa.Table) -> pa.Table:
        """Entries of a range of buckets, packed anew for the next receivers."""
        out = pa.Table.from_batches(list(_pack_entries([_unpack(table, True)], shift)))
        release()
        return out

    return run


@tidy
def _full(batches: Iterator[pa.RecordBatch], rank_of, t: float, bucket_bits: int, only_of) -> Iterator[pa.RecordBatch]:
    """Entries under given words, with whole sets."""
    rank, only = rank_of(), np.unpackbits(only_of(), bitorder="little").astype(bool)
    for batch in batches:
        ids = _ids(batch.column(0))
        for a, b, table, base in tables(batch.column(1)):
            lines = Lines(table, rank, only, base)
            yield _with_sets(_entries(ids[a:b], lines, t, bucket_bits), lines, only)


def _with_sets(entries: list[np.ndarray], lines: Lines, only: np.ndarray | None) -> pa.RecordBatch:
    keep = only[slots(entries[-1])] if only is not None else np.ones(len(entries[-1]), bool)
    *e, rows, word = (c[keep] for c in entries)
    sets = pa.array([lines.keys[lines.first[i] : lines.end[i]].view(np.int64) for i in rows], pa.list_(pa.int64()))
    columns = [word.view(np.int64), e[6], e[7], e[5].astype(np.int64), e[3].astype(np.int64), e[4].view(np.int64), *(w.view(np.int64) for w in e[8:11])]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), sets], names=[f.split()[0] for f in FULL.split(", ")])


def _word(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (bucket.astype(np.uint64) << np.uint64(32)) | key


def _pack_entries(parts: list[list[np.ndarray]], shift: int = 0) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, or for each 2 ** shift of them, which then holds the buckets too; hot ones fall into these ranges by their number."""
    if not parts:
        return
    columns = [np.concatenate([p[i] for p in parts]) for i in range(len(ENTRY) + 1)]
    order = np.argsort(_word(columns[0], columns[1])) if not len(columns[0]) or columns[0].min() >= 0 else np.lexsort((columns[1], columns[0]))
    columns = [c[order] for c in columns]
    bucket = columns[0]
    if shift:
        to = np.where(bucket >= 0, bucket >> shift, (-1 - bucket) % (1 << FAN_BITS))
        order = np.argsort(to, kind="stable")
        columns = [c[order] for c in columns]
        columns, bucket = [to[order], *columns[1:], columns[0]], to[order]
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(bucket))
    if len(at):
        body = [pack(*_sorted_for_pack([c[a:b] for c in columns[1:]])) for a, b in zip(at, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array((ends - at).astype(np.int32)), pa.array(body, pa.binary())], names=["bucket", "n", "body"])


# Buckets


def _sorted_for_pack(columns: list[np.ndarray]) -> list[np.ndarray]:
    """By key, as packing asks for; entries with buckets have several runs of keys."""
    if len(columns) == len(ENTRY):
        return columns
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _unpack(table: pa.Table, with_bucket: bool) -> list[np.ndarray]:
    """Entry columns of all messages, after their buckets if they hold them."""
    kinds = (*ENTRY, np.int64) if with_bucket else ENTRY
    got = [unpack(b, n, *kinds) for b, n in zip(table["body"].to_pylist(), table["n"].to_pylist(), strict=True)]
    out = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, d) for i, d in enumerate(kinds)]
    return [out[-1], *out[:-1]] if with_bucket else out


def _load(table: pa.Table) -> list[np.ndarray]:
    return _unpack(table, False)


def _sorted_entries(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Entries by word, then size, copies of a set side by side with the earliest first; which are later copies, and of which entry; their sides.

    A bucket of a hot word has no other words, and its keys are sides.
    """
    c = _load(table)
    side = np.full(len(c[0]), WITHIN, np.uint32)
    if len(side) and table["bucket"][0].as_py() < 0:
        side, c[0] = c[0], np.zeros(len(side), np.uint32)
    key, _, size, parity, sethash, doc, line = c[:7]
    # Sizes that 16 bits do not hold are ties, ordered below by the true size.
    top = np.where(size < 0xFFFF, sethash >> np.uint32(16), np.uint32(0)).astype(np.uint64)
    both = (key.astype(np.uint64) << np.uint64(32)) | (np.minimum(size, 0xFFFF).astype(np.uint64) << np.uint64(16)) | top
    order = np.argsort(both)
    tied = both[order][1:] == both[order][:-1]
    at = np.flatnonzero(np.concatenate((tied, [False])) | np.concatenate(([False], tied)))
    r = order[at]
    order[at] = r[np.lexsort((line[r], doc[r], c[7][r], parity[r], sethash[r], size[r], both[r]))]
    c = [x[order] for x in c]
    copy = np.zeros(len(order), bool)
    for i in (0, 2, 3, 4, 7):
        same = c[i][1:] == c[i][:-1]
        copy[1:] = same if i == 0 else copy[1:] & same
    lead = np.maximum.accumulate(np.where(copy, 0, np.arange(len(copy))))
    return c, copy, lead, side[order]


def _candidate(c: list[np.ndarray], i: np.ndarray, j: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether pairs pass the positional and parity filters, how many bits differ, and how many may."""
    _, pos, size, parity = c[:4]
    n, m = size[i].astype(np.int64), size[j].astype(np.int64)
    need = overlap(n, m, t)
    reach = 1 + np.minimum(n - pos[i], m - pos[j]) - 1
    most = n + m - 2 * need
    near = parity[i] ^ parity[j]
    differ = np.bitwise_count(near).astype(np.int64)
    long = np.flatnonzero((np.minimum(n, m) > LONG) & (differ <= most))
    if len(long):
        p, q = i[long], j[long]
        parts = [w[p] ^ w[q] for w in c[7:]]
        parts.append(near[long] ^ parts[0] ^ parts[1] ^ parts[2])
        differ[long] = sum(np.bitwise_count(x).astype(np.int64) for x in parts)
    return (reach >= need) & (differ <= most), differ, most


def _places(c: list[np.ndarray], rows: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c[5][rows]), pa.array(c[6][rows]), pa.array(c[4][rows].astype(np.int64))], fields=list(_PLACE))


def _proposals(c: list[np.ndarray], b: np.ndarray, a: np.ndarray, equal: np.ndarray, sure: np.ndarray, more: np.ndarray, distance: np.ndarray) -> pa.Table:
    return pa.table([_places(c, b), _places(c, a), pa.array(equal), pa.array(sure), pa.array(more), pa.array(distance.astype(np.int32))], names=["b", "a", "equal", "sure", "more", "distance"])


def _reach(key: np.ndarray, size: np.ndarray, rest: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the entries of the same word that each entry can match by length, and, larger ones, by position.

    key, size: ascending; rest: words from this position on, no fewer than both lines must share.
    """
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))).astype(np.int64) << 32
    least = np.ceil(t * size - EPS).astype(np.int64)
    most = np.minimum(np.floor(size / t + EPS), np.floor(rest * (1 + t) / t + EPS) - size).astype(np.int64)
    code = group | size
    begin = np.searchsorted(code, group | least, side="left")
    return begin, np.maximum(np.searchsorted(code, group | np.clip(most, 0, (1 << 32) - 1), side="right"), begin)


def _propose(table: pa.Table, t: float) -> pa.Table:
    """For each line under a word its nearest earlier candidates; for copies of a set the earliest, as equal.

    In a bucket of two blocks of a hot word only entries of different blocks meet.
    """
    c, copy, lead, side = _sorted_entries(table)
    across = bool(len(side)) and side[0] < WITHIN
    key, pos, size, _, _, doc, line = c[:7]
    own = np.flatnonzero(~copy)
    n = len(own)
    best, best_of, seen = np.full(n, 1 << 30), np.full(n, -1), np.zeros(n, np.int64)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    s = size[own].astype(np.int64)
    begin, end = _reach(key[own], s, s - pos[own].astype(np.int64), t)
    when = np.empty(n, np.int64)
    when[np.lexsort((line[own], doc[own]))] = np.arange(n)  # rows of one place are ordered by chance, and told apart below
    u, step, stopped = np.arange(n), 0, np.zeros(n, bool)
    behind = np.minimum(u, end)  # to the left of an entry, those before this index can match it by position

    def meet(late: np.ndarray, early: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that pass, their differing bits and how many may differ."""
        early_end = end[early]
        go = (when[early] < when[late]) & ((early > late) | (early_end > late)) 
        if across:
            go &= side[own[early]] != side[own[late]]
        late, early = late[go], early[go]
        passes, x, most = _candidate(c, own[late], own[early], t)
        late, early, x, most = late[passes], early[passes], x[passes], most[passes]
        apart = (doc[own[early]] != doc[own[late]]) | (line[own[early]] != line[own[late]])
        return late[apart], early[apart], x[apart], most[apart]

    while len(u) and (step < 32 or len(u) > 500):
        step += 1
        right, left = u + step < end[u], behind[u] - step >= begin[u]
        for some, early in ((u[right], u[right] + step), (u[left], behind[u[left]] - step)):  # in each an entry occurs once
            b, a, x, most = meet(some, early)
            near = x < best[b]
            best[b[near]], best_of[b[near]] = x[near], a[near]
            few = (seen[b] < NEAREST) & (x > SURE * most)
            kept.append((b[few], a[few], x[few]))
            seen[b] += 1
            # With a sure one among so many there is no need to look on; the second round would.
            stopped[b] |= (seen[b] >= ENOUGH) & (best[b] <= SURE * most)
        u = u[(right | left) & ~stopped[u]]
    for i in u:  # few are left: each meets all others at once
        rest = np.concatenate((np.arange(i + step + 1, end[i]), np.arange(begin[i], max(begin[i], behind[i] - step))))
        _, a, x, most = meet(np.full(len(rest), i), rest)
        if len(a):
            order = np.argsort(x, kind="stable")
            a, x, most = a[order], x[order], most[order]
            if x[0] < best[i]:
                best[i], best_of[i] = x[0], a[0]
            few = np.flatnonzero(x > SURE * most)[: max(0, NEAREST - seen[i])]
            kept.append((np.full(len(few), i), a[few], x[few]))
            seen[i] += len(a)
    seen[stopped] += 1
    s = s.astype(np.float64)
    has = np.flatnonzero(best_of >= 0)
    size_a, size_b = s[best_of[has]].astype(np.int64), s[has].astype(np.int64)
    sure = best[has] <= SURE * (size_a + size_b - 2 * overlap(size_a, size_b, t))
    found_sure = np.zeros(n, bool)
    found_sure[has] = sure
    b2, a2, x2 = (np.concatenate([z[m] for z in kept]) if kept else np.zeros(0, np.int64) for m in range(3))
    other = ~found_sure[b2] & (best_of[b2] != a2)
    b, a, x = np.concatenate((has, b2[other])), np.concatenate((best_of[has], a2[other])), np.concatenate((best[has], x2[other]))
    count = np.bincount(b, minlength=n)
    out = _proposals(c, own[b], own[a], np.zeros(len(b), bool), found_sure[b], seen[b] > count[b], x)
    later = np.zeros(0, np.int64) if across else np.flatnonzero(copy & (pos == 0) & ((doc > doc[lead]) | ((doc == doc[lead]) & (line > line[lead]))))
    no = np.zeros(len(later), bool)
    return pa.concat_tables([out, _proposals(c, later, lead[later], ~no, no, no, np.zeros(len(later), np.int64))])


# Documents that hold given lines


def _holding(docs: DataFrame, places: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with the ``lines`` of the places that lie in them, each as line * 2 ** 32 + hash; broadcast only if counted to be small."""
    packed = F.shiftleft(F.col("line").cast("long"), 32).bitwiseOR(F.col("hash"))
    by_doc = places.groupBy("doc").agg(F.collect_set(packed).alias("__line_asked"))
    n_docs, n_lines = places.agg(F.approx_count_distinct("doc"), F.count(F.lit(1))).first()
    small = 72 * n_docs + 8 * n_lines <= BROADCAST_BYTES
    keyed = docs.withColumn("__line_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))))
    by_doc = by_doc.withColumnRenamed("doc", "__line_doc")
    return keyed.join(F.broadcast(by_doc) if small else by_doc, "__line_doc", how).drop("__line_doc")


def _requested(texts: pa.Array, asked: pa.Array, rank: np.ndarray):
    """Runs of asked lines that have the asked hash: owning row, line number, their ``Lines`` and rows there.  Only these lines are read."""
    owner, number, want, body = [], [], [], []
    for d, (text, packed) in enumerate(zip(texts.to_pylist(), asked.to_pylist(), strict=True)):
        if text is None or not packed:
            continue
        parts = text.split("\n")
        for x in packed:
            line = x >> 32
            if line < len(parts):
                owner.append(d)
                number.append(line)
                want.append(x & 0xFFFFFFFF)
                body.append(parts[line])
    owner, number, want = np.array(owner, np.int64), np.array(number, np.int32), np.array(want, np.uint32)
    for a, _, t in chunks(pa.array(body, pa.string())):
        lines = Lines(t, rank)
        rows = np.flatnonzero(lines.hash == want[a + lines.doc])
        at = a + lines.doc[rows]
        yield owner[at], number[at], lines, rows


@tidy
def _sets(batches: Iterator[pa.RecordBatch], rank_of) -> Iterator[pa.RecordBatch]:
    """Words of the asked lines; repeated rows give them once a task."""
    rank, seen = rank_of(), set()
    for batch in batches:
        ids = _ids(batch.column(0))
        for owner, number, lines, rows in _requested(batch.column(1), batch.column(2), rank):
            keys = list(zip(ids[owner].tolist(), number.tolist(), lines.hash[rows].tolist(), strict=True))
            new = np.array([k for k, key in enumerate(keys) if not (key in seen or seen.add(key))], np.int64)
            place = pa.StructArray.from_arrays([pa.array(ids[owner[new]]), pa.array(number[new]), pa.array(lines.hash[rows[new]].astype(np.int64))], fields=list(_PLACE))
            words = pa.array([lines.keys[lines.first[i] : lines.end[i]].view(np.int64) for i in rows[new]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([place, words], names=["place", "words"])


@tidy
def _probe(batches: Iterator[pa.RecordBatch], rank_of, t: float, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """Entries of the asked lines, with whole sets."""
    rank = rank_of()
    for batch in batches:
        ids = _ids(batch.column(0))
        for owner, number, lines, rows in _requested(batch.column(1), batch.column(2), rank):
            line, doc = np.zeros(len(lines.size), np.int32), np.zeros(len(lines.size), np.int64)
            line[rows], doc[rows] = number, ids[owner]
            lines.line, lines.doc = line, np.arange(len(lines.size))
            for r in rows:
                yield _with_sets(_entries(doc, lines, t, bucket_bits, np.array([r])), lines, None)


def _any_match(docs: DataFrame, open_lines: DataFrame, rank_of, t: float, bucket_bits: int) -> DataFrame:
    """Those of ``open_lines`` that have an earlier similar line, found by a semi-join on the words of their prefixes."""
    spark = docs.sparkSession
    settings = {"rank_of": rank_of, "t": t, "bucket_bits": bucket_bits}
    probes = cut(_holding(docs, open_lines).mapInArrow(partial(_probe, **settings), FULL))
    only = spark.sparkContext.broadcast(_flags(probes.select(F.col("word").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot"))))  # 2 MB at every size
    entries = docs.mapInArrow(partial(_full, **settings, only_of=partial(_value, only)), FULL)
    b, a = probes.alias("b"), entries.alias("a")
    n, m = F.col("b.size"), F.col("a.size")
    early = (F.col("a.doc") < F.col("b.doc")) | ((F.col("a.doc") == F.col("b.doc")) & (F.col("a.line") < F.col("b.line")))
    most = n + m - 2 * F.ceil(F.lit(t / (1 + t)) * (n + m) - EPS)
    bits = [F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}")) for i in range(4)]
    wide = F.bit_count(bits[1]) + F.bit_count(bits[2]) + F.bit_count(bits[3]) + F.bit_count(bits[0].bitwiseXOR(bits[1]).bitwiseXOR(bits[2]).bitwiseXOR(bits[3]))
    differ = F.when(F.least(n, m) > LONG, wide).otherwise(F.bit_count(bits[0]))
    shared = F.size(F.array_intersect("a.words", "b.words"))
    match = early & (F.least(n, m) >= F.lit(t) * F.greatest(n, m) - EPS) & (differ <= most) & (shared * (1 + t) >= t * (n + m) - EPS)
    return b.join(a, (F.col("a.word") == F.col("b.word")) & match, "left_semi").select("doc", "line", "hash").distinct()


def _flags(found: DataFrame) -> np.ndarray:
    """Bits of the slots that occur, packed from the lowest on."""
    out = np.zeros(1 << SLOT_BITS >> 3, np.uint8)
    width = 1 << 15  # bits of a row
    # Bitmap functions count from 1 in the bucket numbers.
    rows = found.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for r in rows.collect():
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * (width >> 3)
        out[at : at + len(bits)] |= bits
    return out


def _verified(docs: DataFrame, pairs: DataFrame, rank_of, t: float) -> DataFrame:
    """Pairs with ``match``: whether the whole sets reach the threshold."""
    places = pairs.select(F.explode(F.array("a", "b")).alias("p")).select("p.*").distinct()
    held = _holding(docs.select("doc_id", "text"), places)
    sets = held.mapInArrow(partial(_sets, rank_of=rank_of), "place struct<doc: long, line: int, hash: long>, words array<long>")
    left = sets.select(F.col("place").alias("a"), F.col("words").alias("a_words"))
    right = sets.select(F.col("place").alias("b"), F.col("words").alias("b_words"))
    both = F.size(F.array_intersect("a_words", "b_words"))
    enough = both * (1 + t) >= t * (F.size("a_words") + F.size("b_words")) - EPS
    return pairs.join(left, "a").join(right, "b").select("b", "a", enough.alias("match"))


def similar_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Places (``doc, line, hash``) of lines that are similar to an earlier line.

    ``line`` counts from 0 within a document, ``hash`` is of the word set, null ids
    are the greatest number.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    small_batches(spark)
    rank, n_words = rarity(docs)
    shared = spark.sparkContext.broadcast(rank)  # 2 MB at every size
    rank_of = partial(_value, shared)
    bucket_bits = min(32, max(0, -(-n_words // BUCKET_WORDS) - 1).bit_length())
    found_hot = hot_words(docs, rank_of, threshold)
    hot = spark.sparkContext.broadcast((found_hot.words, found_hot.blocks))  # plain arrays, as executors need not have this package
    entries = docs.mapInArrow(partial(_index, rank_of=rank_of, t=threshold, bucket_bits=bucket_bits, hot_of=partial(_hot, hot)), "bucket long, n int, body binary")
    upto = FAN_BITS
    while upto < bucket_bits:
        # Nodes that share a range of buckets, so that each holds about what a bucket does.
        shares = 1 << (bucket_bits - upto)
        node = F.col("bucket") * shares + F.pmod(F.xxhash64("body"), F.lit(shares))
        upto += FAN_BITS
        entries = entries.withColumn("node", node).groupBy("node").applyInArrow(_passing(max(0, bucket_bits - upto)), "bucket long, n int, body binary")
    proposed = cut(entries.groupBy("bucket").applyInArrow(_grouped(_propose, threshold), PROPOSAL))
    equal = proposed.where("equal").select("b").distinct()
    best = F.min(F.struct(~F.col("sure"), "distance", "a")).alias("best")
    by_line = proposed.where("NOT equal").groupBy("b").agg(best, F.collect_set("a").alias("all"), F.max("more").alias("more"))
    sure = ~F.col("best.col1")
    chosen = by_line.join(equal, "b", "left_anti").select("b", F.explode(F.when(sure, F.array("best.a")).otherwise(F.col("all"))).alias("a"), (F.col("more") | (sure & (F.size("all") > 1))).alias("more"))
    chosen = cut(chosen)
    verdict = cut(_verified(docs, chosen.select("a", "b"), rank_of, threshold).groupBy("b").agg(F.max("match").alias("match")))
    found = equal.unionByName(verdict.where("match").select("b"))
    # Lines all of whose proposals failed though they had others.
    open_lines = cut(verdict.where("NOT match").join(chosen.where("more").select("b").distinct(), "b", "left_semi").select("b.*"))
    found = found.select("b.*")
    if open_lines.take(1):
        found = found.unionByName(_any_match(docs, open_lines, rank_of, threshold, bucket_bits))
    return cut(found.distinct())


def _value(shared):
    return shared.value


def _hot(shared) -> Hot:
    return Hot(*shared.value)


def _grouped(f, t: float):
    def run(table):
        out = f(table, t)
        release()
        return out

    return run


def dedup(docs: DataFrame, threshold: float = THRESHOLD, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text`` less its later lines, and ``n_lines``, ``n_removed`` (long).

    Lines are split at ``\\n``; a line's set is of its words (runs of other bytes
    than x20, x09-x0D).  A line goes if an earlier one, of a smaller id or further up
    in the same document, has a Jaccard similarity of ``threshold`` or more; lines
    are judged on the input, also against lines that go themselves.  Lines without
    words stay.  A null text stays null and has no lines; a null id comes after all
    others.  Lines at one place (rows of one id, same line number) do not remove
    each other.  Other columns stay; those named like the two ``counts`` are replaced,
    names beginning with ``__line_`` are reserved.

    Sets are compared by 64-bit word hashes; sets equal in rarest word, size, parity
    and two hashes (128 bits beside the parity; of lines of over 96 words 320 with it)
    are taken for equal.
    """
    gone = similar_lines(docs, threshold)
    others = [f for f in docs.schema if f.name not in ("doc_id", "text", *counts)]
    shared = _holding(docs.select("doc_id", "text", *[F.col(f"`{f.name}`") for f in others]), gone, "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "__line_asked", *[F.col(f"`{f.name}`") for f in others])
    schema = ", ".join(["doc_id long, text string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{counts[0]}` long, `{counts[1]}` long"])

    names = ["doc_id", "text", *(f.name for f in others), *counts]

    @tidy
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = np.arange(1 << RANK_BITS, dtype=np.uint64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_lines = [0 if x is None else x.count("\n") + 1 for x in texts]
            removed = [0] * len(texts)
            drop: dict[int, set[int]] = {}
            for owner, number, _, _ in _requested(batch.column(1), batch.column(2), plain):
                for i, k in zip(owner.tolist(), number.tolist(), strict=True):
                    drop.setdefault(i, set()).add(k)
            for i, gone_here in drop.items():
                texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone_here)
                removed[i] = len(gone_here)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[3:], pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64())], names=names)

    return map_batches(shared, rewrite, schema)
