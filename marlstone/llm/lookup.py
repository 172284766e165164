"""Sums by key over all parts of a table, and an answer for each key back to the parts that hold it.

A part sends its distinct keys (64 bits, spread evenly over the first ones) with a
number each, packed, to buckets of keys; a bucket adds up the numbers of equal keys
and sends a value for each back.  A sender addresses at most ``2 ** FAN_BITS``
receivers: with more buckets, nodes in between gather a range of keys from some of
the parts, merge equal ones and pass them on, so that messages grow with the input.
A key that every document holds is one entry a sender.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import pack, unpack

#: A sender has up to so many receivers, as a power of two.
FAN_BITS = 11
MESSAGE = "kind int, part long, bucket long, n int, body binary"

U = np.uint64


@dataclass(frozen=True)
class Level:
    """How senders address receivers: by the first ``upto`` of the ``bits`` that tell buckets apart."""

    bits: int
    upto: int

    @classmethod
    def first(cls, buckets: int) -> Level:
        bits = min(32, max(0, buckets - 1).bit_length())
        return cls(bits, min(bits, FAN_BITS))

    @property
    def last(self) -> bool:
        return self.upto == self.bits

    @property
    def deeper(self) -> Level:
        return Level(self.bits, min(self.bits, self.upto + FAN_BITS))


def distinct(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(numbers[order], starts) if len(starts) else np.zeros(0, np.int64)


def _to(keys: np.ndarray, level: Level):
    """Receiver, first and end of each run of ascending keys."""
    if not len(keys):
        return
    receiver = keys >> U(64 - level.upto) if level.upto else np.zeros(len(keys), U)
    at = np.concatenate(([0], np.flatnonzero(receiver[1:] != receiver[:-1]) + 1, [len(keys)]))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(receiver[a]), a, b


def messages(kind: int, sender: int, keys: np.ndarray, numbers: np.ndarray, level: Level):
    """A message to each receiver of ascending keys."""
    for receiver, a, b in _to(keys, level):
        yield kind, sender, receiver, b - a, pack(keys[a:b], numbers[a:b])


def as_table(rows) -> pa.Table:
    rows = list(rows)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "part", "bucket", "n", "body"])


def answers(keys: np.ndarray, replies: dict[int, bytes], level: Level, dtype: type) -> np.ndarray:
    """Values of ascending keys from the replies by receiver."""
    out = np.zeros(len(keys), dtype)
    for receiver, a, b in _to(keys, level):
        out[a:b] = unpack(replies[receiver], b - a, U, dtype)[1]
    return out


def replies(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: body for k, b, body in zip(*(table[c].to_pylist() for c in ("kind", "bucket", "body")), strict=True) if k == kind}


class Gathered:
    """Messages of one kind at a receiver: ascending ``keys`` and their sums, and where each sender's entries are among them."""

    def __init__(self, kind: int, table: pa.Table):
        self.messages = table.filter(pc.equal(table["kind"], kind)).sort_by([("part", "ascending"), ("bucket", "ascending")])
        ns = self.messages["n"].to_pylist()
        self.at = np.concatenate(([0], np.cumsum(ns, dtype=np.int64)))
        parts = [unpack(body, n, U, np.int64) for body, n in zip(self.messages["body"].to_pylist(), ns, strict=True)]
        self._keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U)
        self.keys, self.numbers = distinct(self._keys, np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64))

    def reply(self, values: np.ndarray) -> pa.Table:
        """A value for each of ``keys``, back to all that sent it."""
        no_keys = np.zeros(0, U)
        of = np.searchsorted(self.keys, self._keys)
        body = [pack(np.zeros(b - a, U), values[of[a:b]]) if b > a else pack(no_keys, values[:0]) for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        return self.messages.select(["kind", "part", "bucket", "n"]).append_column("body", pa.array(body, pa.binary()))


def _forward(sent: DataFrame, parts: int, level: Level, kinds: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Messages with their nodes, several to a receiver so that each holds about what a part has; and what the nodes send on."""
    shares = max(1, -(-parts >> level.upto))
    dealt = sent.withColumn("node", F.col("bucket") * shares + F.pmod(F.xxhash64("part"), F.lit(shares)))

    def forward(key, table):
        rows = []
        for kind in kinds:
            g = Gathered(kind, table)
            rows += messages(kind, key[0].as_py(), g.keys, g.numbers, level.deeper)
        return as_table(rows)

    return dealt, dealt.groupBy("node").applyInArrow(forward, MESSAGE)


def arrived(sent: DataFrame, parts: int, level: Level, kinds: tuple[int, ...]) -> DataFrame:
    """The messages as the buckets get them."""
    while not level.last:
        sent, level = _forward(sent, parts, level, kinds)[1], level.deeper
    return sent


def exchange(sent: DataFrame, parts: int, level: Level, answer: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]], dtypes: dict[int, type]) -> DataFrame:
    """Replies to messages: by kind, ``answer`` gives a value for each key and its sum over all parts."""
    if level.last:

        def settle(table):
            out = []
            for kind, f in answer.items():
                g = Gathered(kind, table)
                out.append(g.reply(f(g.keys, g.numbers).astype(dtypes[kind])))
            return pa.concat_tables(out)

        return sent.groupBy("bucket").applyInArrow(settle, MESSAGE)
    dealt, passed_on = _forward(sent, parts, level, tuple(answer))

    def backward(key, table, replied):
        out = []
        for kind in answer:
            g = Gathered(kind, table)
            out.append(g.reply(answers(g.keys, replies(replied, kind), level.deeper, dtypes[kind])))
        return pa.concat_tables(out)

    answered = exchange(passed_on, parts, level.deeper, answer, dtypes)
    return dealt.groupBy("node").cogroup(answered.groupBy("part")).applyInArrow(backward, MESSAGE)
