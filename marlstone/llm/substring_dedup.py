"""Substring dedup on fixed-block anchors.

Documents are dealt into parts by id and text.  Every part indexes the non-overlapping
blocks of its documents, aligned to multiples of ``width // 2`` words, and probes
the index of all parts with every rolling window of that size.  Any repeat of
``width`` words holds an aligned block of its earlier place whole, so each repeat
hits.  Hits are extended: all windows of ``width`` words around a hit are compared
across parts by 96 bits of hash (64 of one hash of words and runs, 32 of another),
and those that start earlier elsewhere are repeats; overlapping ones join to
maximal repeats.

Between parts and the buckets of the index travel sorted, distinct, packed
hashes, and a bit for each comes back.  A sender addresses at most ``2 ** FAN_BITS``
receivers: with more buckets than that, nodes in between gather a range of buckets
from some of the parts, merge equal hashes and pass them on, so that the number of
messages grows with the input and not with its square.  A passage that a third of
all documents hold is one entry a sender, never a group of rows.  Short hashes of
the anchors may let through a false hit, which the second comparison refutes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import bits, pack, unpack
from .wordtable import IS_SPACE, chunks, hashed, runs

WIDTH = 20
#: MB of text in a part; a task holds one part, or the entries of several in one bucket, at a time.
PART_MB = 8
PARTS_A_BUCKET = 4
#: A sender has up to so many receivers, as a power of two.
FAN_BITS = 11
#: Bytes of a chunk of the result.
RESULT_BYTES = 256 << 20

MESSAGE = "kind int, part long, bucket long, n int, body binary"
RESULT = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<start: int, end: int>>"

ANCHOR, WINDOW = 1, 2
LAST = np.iinfo(np.int64).max
U = np.uint64


class Part:
    """One part: its documents by id, tie, then text, and the anchors of their words."""

    def __init__(self, table: pa.Table, width: int, bucket_bits: int):
        table = table.set_column(table.schema.get_field_index("text"), "text", table["text"].cast(pa.large_string()))
        by = pc.sort_indices(table.select(["doc_id", "tie", "text"]), [("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")])
        self.table = table.take(by).combine_chunks()
        self.ids = self.table["doc_id"].fill_null(LAST).to_numpy()
        self.ties = self.table["tie"].to_numpy()
        self.width, self.bucket_bits = width, bucket_bits
        column = self.table["text"]
        self.text = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
        self.words, self.offsets = hashed(self.text)
        self.anchor_first, anchors = runs(self.words, self.offsets, width // 2)
        self.codes, self.code_of = np.unique(anchors >> U(32 - bucket_bits), return_inverse=True)

    def _doc_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, words, side="right") - 1

    def anchor_messages(self, part: int, level: Level):
        """Anchor hashes, whether an aligned block has each, whether it occurs twice here."""
        place = self.anchor_first - self.offsets[self._doc_of(self.anchor_first)]
        aligned = np.zeros(len(self.codes), bool)
        aligned[self.code_of[place % (self.width // 2) == 0]] = True
        twice = np.bincount(self.code_of, minlength=len(self.codes)) > 1
        return level.messages(ANCHOR, part, [self.codes, aligned, twice])

    def extend(self, replies: dict[int, bytes], level: Level) -> None:
        """Windows of full width around the hits; equal ones of the part are one entry."""
        hit = level.answers(ANCHOR, self.codes, replies)[self.code_of]
        total = np.zeros(len(self.words) + 1, np.int64)
        total[self.anchor_first + 1] = hit
        total = np.cumsum(total)
        first, h1 = runs(self.words, self.offsets, self.width)
        near = total[first + self.width - self.width // 2 + 1] > total[first]
        self.first, self.h1 = first[near], h1[near]
        self.h2 = np.zeros(0, np.uint32)
        if len(self.first):
            self.h2 = (runs(hashed(self.text, 1)[0], self.offsets, self.width, 1)[1][near] >> U(32)).astype(np.uint32)
        order = np.lexsort((self.first, self.h2, self.h1))
        x, y = self.h1[order], self.h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.leads = order[new]  # the earliest window of each entry

    def window_messages(self, part: int, level: Level):
        w = self.leads
        doc = self._doc_of(self.first[w])
        return level.messages(WINDOW, part, [self.h1[w], self.h2[w], self.ids[doc], self.ties[doc]])

    def result(self, replies: dict[int, bytes], level: Level) -> pa.Table:
        """Documents without the words of windows that are later ones, here or of another part."""
        later = level.answers(WINDOW, self.h1[self.leads], replies)[self.entry]
        own = np.ones(len(self.first), bool)
        own[self.leads] = False
        starts = self.first[later | own]
        steps = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + self.width, -1)
        gone = np.cumsum(steps[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[self.offsets[1:]] - total[self.offsets[:-1]]
        repeats: list[list[dict]] = [[] for _ in removed]
        for d in np.flatnonzero(removed):
            cut_here = gone[self.offsets[d] : self.offsets[d + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], cut_here.view(np.int8), [0]))))
            repeats[d] = [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]
        columns = [self.table["doc_id"], pa.array(np.diff(self.offsets)), pa.array(removed), self._kept(gone), pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept", "repeats"])

    def _kept(self, gone: np.ndarray) -> pa.ChunkedArray:
        """The other words of each document, joined by single spaces."""
        size, body, word, wrote = np.zeros(len(self.ids), np.int64), [], 0, np.zeros(len(self.ids), bool)
        for a, b, t in chunks(self.text, cut_at=IS_SPACE):
            stay = np.flatnonzero(~gone[word : word + len(t.start)])
            word += len(t.start)
            doc = a + t.doc_of_word[stay]
            lead = np.ones(len(stay), np.int64)  # a space, but before the first word of a document
            opens = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
            lead[opens & ~wrote[doc]] = 0
            wrote[doc] = True
            long = t.end[stay] - t.start[stay]
            end = np.cumsum(long + lead)
            out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
            at = np.repeat(t.start[stay] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
            into = np.repeat(end - long - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
            out[into] = t.data[at]
            body.append(out.tobytes())
            size += np.bincount(doc, weights=long + lead, minlength=len(size)).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(size)))
        whole = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(body))])
        out, row = [], 0
        while row < len(size):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + RESULT_BYTES, side="right")) - 1)
            out.append(whole.slice(row, stop - row).cast(pa.string()))
            row = stop
        return pa.chunked_array(out, pa.string())


class Level:
    """How senders of one level address receivers: by the first ``upto`` bits of a code, all before ``since`` being known.

    Codes of anchors have ``bucket_bits + 32`` bits, of windows 64.
    """

    def __init__(self, bucket_bits: int, since: int, upto: int):
        self.bucket_bits, self.since, self.upto = bucket_bits, since, upto

    def _to(self, kind: int, codes: np.ndarray) -> np.ndarray:
        width = self.bucket_bits + 32 if kind == ANCHOR else 64
        return codes >> U(width - self.upto) if self.upto else np.zeros(len(codes), np.uint64)

    def messages(self, kind: int, sender: int, columns: list[np.ndarray]):
        """A message to each receiver; the first column is of ascending codes."""
        for bucket, a, b in _slices(self._to(kind, columns[0])):
            part = [c[a:b] for c in columns]
            if kind == ANCHOR:
                rest = self.bucket_bits + 32 - self.upto
                part[0] = part[0] & U((1 << rest) - 1)
                part[0] = part[0].astype(np.uint32) if rest == 32 else part[0]
            yield kind, sender, bucket, b - a, pack(*part)

    def load(self, kind: int, messages: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns of all messages of a receiver, laid end to end, and where each begins."""
        rest = self.bucket_bits + 32 - self.upto
        dtypes = (np.uint32 if rest == 32 else np.uint64, bool, bool) if kind == ANCHOR else (np.uint64, np.uint32, np.int64, np.int64)
        ns = messages["n"].to_pylist()
        columns = [unpack(body, n, *dtypes) for body, n in zip(messages["body"].to_pylist(), ns, strict=True)]
        out = [np.concatenate([c[i] for c in columns]) if columns else np.zeros(0, d) for i, d in enumerate(dtypes)]
        if kind == ANCHOR and columns:
            head = np.repeat(messages["bucket"].to_numpy().astype(np.uint64), ns)
            out[0] = (head << U(rest)) | out[0].astype(np.uint64)
        return out, np.concatenate(([0], np.cumsum(ns, dtype=np.int64)))

    def answers(self, kind: int, codes: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(codes), bool)
        for bucket, a, b in _slices(self._to(kind, codes)):
            if bucket in replies:
                out[a:b] = bits(replies[bucket], b - a)
        return out


def _slices(buckets: np.ndarray):
    """Bucket, first and end of each run of an ascending array."""
    if not len(buckets):
        return
    at = np.concatenate(([0], np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, [len(buckets)]))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(buckets[a]), a, b


def _messages(rows) -> pa.Table:
    rows = list(rows)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "part", "bucket", "n", "body"])


def _replies(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: body for k, b, body in zip(*(table[c].to_pylist() for c in ("kind", "bucket", "body")), strict=True) if k == kind}


class Merged:
    """Entries of several senders, equal ones as one."""

    def __init__(self, kind: int, columns: list[np.ndarray]):
        self.kind, self.columns = kind, columns
        if kind == ANCHOR:
            codes, aligned, twice = columns
            order = np.argsort(codes, kind="stable")
            new = _changes(codes[order])
        else:
            codes, h2, owner, tie = columns
            order = np.lexsort((tie, owner, h2, codes))
            new = _changes(codes[order], h2[order])
        starts = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        lead = order[starts]
        if kind == ANCHOR:
            several = np.diff(np.append(starts, len(order))) > 1
            either = lambda x: np.logical_or.reduceat(x[order], starts) if len(starts) else x
            self.entries = [codes[lead], either(aligned), several | either(twice)]
        else:
            self.entries = [c[lead] for c in columns]

    def settle(self) -> np.ndarray:
        """By entry of the senders: an anchor hits if an aligned block has it and it occurs twice or more; a window is a later one if a smaller owner has it."""
        if self.kind == ANCHOR:
            return (self.entries[1] & self.entries[2])[self.of]
        _, _, owner, tie = self.columns
        least, least_tie = (c[self.of] for c in self.entries[2:])
        return (owner > least) | ((owner == least) & (tie > least_tie))

    def back(self, reply: np.ndarray) -> np.ndarray:
        """By entry of the senders, given the answers to the merged entries."""
        return reply[self.of] if self.kind == ANCHOR else reply[self.of] | self.settle()


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _gathered(level: Level, kind: int, messages: pa.Table) -> tuple[pa.Table, Merged, np.ndarray]:
    messages = messages.filter(pc.equal(messages["kind"], kind)).sort_by([("part", "ascending"), ("bucket", "ascending")])
    columns, at = level.load(kind, messages)
    return messages, Merged(kind, columns), at


def _reply(messages: pa.Table, flags: np.ndarray, at: np.ndarray) -> pa.Table:
    body = [np.packbits(flags[a:b]).tobytes() if flags[a:b].any() else None for a, b in zip(at[:-1], at[1:], strict=True)]
    out = messages.select(["kind", "part", "bucket", "n"]).append_column("body", pa.array(body, pa.binary()))
    return out.filter(pc.is_valid(pa.array(body, pa.binary())))


def nodes(parts: int, level: Level) -> int:
    """Nodes that share a receiver of a level, so that each holds about what a part has."""
    return max(1, -(-parts >> level.upto))


def exchange(sent: DataFrame, kind: int, parts: int, level: Level) -> DataFrame:
    """Replies to messages that senders address by ``level``, over as many levels more as there are bits left."""
    if level.upto == level.bucket_bits:

        def settle(table):
            messages, merged, at = _gathered(level, kind, table)
            return _reply(messages, merged.settle(), at)

        return sent.groupBy("bucket").applyInArrow(settle, MESSAGE)
    shares = nodes(parts, level)
    deeper = Level(level.bucket_bits, level.upto, min(level.bucket_bits, level.upto + FAN_BITS))
    dealt = sent.withColumn("node", F.col("bucket") * shares + F.pmod(F.xxhash64("part"), F.lit(shares)))

    def forward(key, table):
        _, merged, _ = _gathered(level, kind, table)
        return _messages(deeper.messages(kind, key[0].as_py(), merged.entries))

    def backward(key, table, replies):
        messages, merged, at = _gathered(level, kind, table)
        reply = deeper.answers(kind, merged.entries[0], _replies(replies, kind))
        return _reply(messages, merged.back(reply), at)

    answered = exchange(dealt.groupBy("node").applyInArrow(forward, MESSAGE), kind, parts, deeper)
    return dealt.groupBy("node").cogroup(answered.groupBy("part")).applyInArrow(backward, MESSAGE)


def _dealt(docs: DataFrame, part_mb: float) -> tuple[DataFrame, int]:
    """``doc_id, text, tie, part``, and the number of parts: dealt by id and ``tie``, a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / (part_mb * 1e6)))
    return docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)).cast("long")), parts


def dedup(docs: DataFrame, width: int = WIDTH, part_mb: float = PART_MB) -> DataFrame:
    """Every document without later copies of passages: ``RESULT``.

    A word goes if it lies in a window of ``width`` consecutive words of one
    document that also starts earlier: in a smaller id, or the same document
    further up.  Windows are judged on the input.  ``kept`` joins the other words
    by single spaces, ``repeats`` are the maximal removed ranges of words.

    Reads ``doc_id`` and ``text``; other columns are ignored.  A null text has no
    words, a null id comes after all others, and rows of one id are ordered by a hash
    of the text, then by text, so of a repeated row all copies but one are later ones.  An empty table gives an empty one.
    """
    dealt, parts = _dealt(docs, part_mb)
    bucket_bits = min(32, max(0, -(-parts // PARTS_A_BUCKET) - 1).bit_length())
    level = Level(bucket_bits, 0, min(bucket_bits, FAN_BITS))

    def announce(key, table):
        return _messages(Part(table, width, bucket_bits).anchor_messages(key[0].as_py(), level))

    def extend(key, table, replies):
        if not table.num_rows:
            return _messages(())
        part = Part(table, width, bucket_bits)
        part.extend(_replies(replies, ANCHOR), level)
        return _messages(part.window_messages(key[0].as_py(), level))

    def finish(key, table, replies):
        part = Part(table, width, bucket_bits)
        part.extend(_replies(replies, ANCHOR), level)
        return part.result(_replies(replies, WINDOW), level)

    by_part = dealt.groupBy("part")
    hits = exchange(by_part.applyInArrow(announce, MESSAGE), ANCHOR, parts, level)
    later = exchange(by_part.cogroup(hits.groupBy("part")).applyInArrow(extend, MESSAGE), WINDOW, parts, level)
    return by_part.cogroup(hits.unionByName(later).groupBy("part")).applyInArrow(finish, RESULT)
