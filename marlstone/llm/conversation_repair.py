"""Repair of conversation structure by a forward Viterbi search over four grammar states.

A conversation in order is an optional system turn, then pairs of a user and an
assistant turn, or nothing.  Rows arrive sorted, a conversation streams through one
task, and the search carries for each state the least cost and, of equal ones, the
least audit string, with a running digest of the rows as repaired on that path.  So
a task holds no rows but four paths, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import map_batches, small_batches, tidy

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
OPENED, SYSTEM, USER, ASSISTANT = range(4)
#: From a state, by the initial of the role that comes next.
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one role that a rerole or an insert can give in a state, and where it leads.
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
ENDS = (OPENED, ASSISTANT)
#: No state is further than so many inserts from another.
MOST_INSERTS = 2
#: Rows after which the strings that each row extends are put aside.
FOLD_EVERY = 64

COUNTS = "gaps blank duplicate truncated illegal cost".split()
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"

SPACE = " \t\n\x0b\x0c\r"


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults: crc32 of ``conv_id:turn`` modulo 20 drops a row (0), empties its text (1), removes ``[.!?]`` (2), repeats it (3) or makes it the user's (4).  Nulls of role, text and in the key are one space."""
    fault = F.crc32(F.concat_ws(":", _filled("conv_id"), _filled("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(_filled("text"), "[.!?]", "")).otherwise(_filled("text"))
    times = F.when(fault == 3, 2).otherwise(1)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(_filled("role")).alias("role"), text.alias("text"), fault.alias("__fault"), times.alias("__times"))
    return rows.where("__fault <> 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("conv_id", "turn", "role", "text")


class Path(NamedTuple):
    """A way to a state.  ``(cost, rank, tail)`` orders paths: their audits are ``head`` and ``tail``, heads of other ranks differ before their ends."""

    cost: int
    rank: int
    tail: str
    head: tuple | None  # (head before, string)
    digest: Any  # of the repaired rows

    def then(self, cost: int, edit: str, line: str | None = None, first: bool = False) -> Path:
        digest = self.digest
        if line is not None:
            digest = digest.copy()
            digest.update((line if first else "\n" + line).encode())
        return Path(self.cost + cost, self.rank, self.tail + edit, self.head, digest)

    def audit(self) -> str:
        parts, head = [self.tail], self.head
        while head is not None:
            head, part = head
            parts.append(part)
        return "".join(reversed(parts))


class Search:
    """The state of one conversation: counts, and the best path to each grammar state."""

    def __init__(self) -> None:
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.last_turn = None
        self.turns = self.rows = 0
        self.initial: str | None = None  # of the row before
        self.best: list[Path | None] = [Path(0, 0, "", None, hashlib.sha256()), None, None, None]
        self._insert()

    def _offer(self, layer: list[Path | None], to: int, since: int, cost: int, edit: str, line: str | None) -> None:
        path = self.best[since]
        rival = layer[to]
        if rival is None or (path.cost + cost, path.rank, path.tail + edit) < rival[:3]:
            layer[to] = path.then(cost, edit, line, since == OPENED)

    def _insert(self) -> None:
        """Close a layer: from each state by inserts to the others."""
        for _ in range(MOST_INSERTS):
            for state in range(4):
                if self.best[state] is not None:
                    to, role = NEXT[state]
                    self._offer(self.best, to, state, INSERT, "I", f"{role}:")

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
        initial = role[:1]
        self.count["illegal"] += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        last = text.rstrip(SPACE)[-1:]
        fault = "blank" if not last else "duplicate" if repeated else "truncated" if last not in ".!?" else None
        if fault:
            self.count[fault] += 1
        cut_off = int(fault == "truncated")
        layer: list[Path | None] = [None] * 4
        for state in range(4):
            if self.best[state] is None:
                continue
            self._offer(layer, state, state, DELETE, "D", None)
            if fault not in ("blank", "duplicate"):
                to, other = NEXT[state]
                self._offer(layer, to, state, REROLE + cut_off, "R", f"{other}:{text}")
                if initial in STEPS[state]:
                    self._offer(layer, STEPS[state][initial], state, KEEP + cut_off, "K", f"{role}:{text}")
        self.best = layer
        self._insert()
        self.rows += 1
        if self.rows % FOLD_EVERY == 0:
            self._fold()

    def _fold(self) -> None:
        """Move tails to heads.  Of a head's tails those that begin with another one keep what goes beyond, so that no head begins with another."""
        base = {}
        for path in self.best:
            if path is not None:
                base[path.rank, path.tail] = min((q.tail for q in self.best if q is not None and q.rank == path.rank and path.tail.startswith(q.tail)), key=len)
        heads = {k: n for n, k in enumerate(sorted({(rank, short) for (rank, _), short in base.items()}))}
        made: dict[tuple[int, str], tuple] = {}
        for state, path in enumerate(self.best):
            if path is not None:
                key = path.rank, base[path.rank, path.tail]
                head = made.setdefault(key, (path.head, key[1]))
                self.best[state] = path._replace(rank=heads[key], tail=path.tail[len(key[1]) :], head=head)

    def finish(self) -> list:
        path = min((self.best[s] for s in ENDS if self.best[s] is not None), key=lambda p: p[:3])
        self.count["cost"] = path.cost
        if self.low is not None:
            self.count["gaps"] = self.high - self.low + 1 - self.turns
        return [*(self.count[c] for c in COUNTS), path.audit(), path.digest.hexdigest()]


def _search(keys: list, rows: tuple, open_search: tuple | None) -> tuple[list, tuple]:
    """Feed sorted rows; give the results of conversations that have ended, and the last, which may go on."""
    done = []
    for key, turn, role, text, repeated in zip(keys, *rows, strict=True):
        if open_search is None or open_search[0] != key:
            if open_search is not None:
                done.append([open_search[0], *open_search[1].finish()])
            open_search = (key, Search())
        open_search[1].row(turn, role, text, repeated)
    return done, open_search


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Faults and cheapest repair of each conversation: ``RESULT``.

    turns: ``conv_id, turn, role, text``, other columns are ignored; conversations:
    ``conv_id`` of those that must have a row even if no turn is left.  Rows are taken
    by turn (nulls first), then role and text.  Each counts for its first fault: blank
    (nothing but white space), duplicate (role and text seen earlier), truncated (the
    last character that is not white space is none of ``.!?``).  Edits are keep (K, 0),
    rerole to user or assistant (R, 2), delete (D, 3; needed for blank and duplicate)
    and insert of an empty user or assistant turn (I, 2); a truncated row that stays
    costs 1 more.  Of equal costs the least audit string wins.  A null role or text is
    one space, null ids are one
    conversation; an empty table gives an empty one.

    Two shuffles: by (conversation, role, digest of the text) earlier copies are told,
    then rows are sorted by conversation and streamed.  Digest and audit of a
    conversation need its rows in order, so one conversation is one task's stream; it
    holds four paths, of some bytes a row.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"), _filled("text").alias("text"))
    copies = W.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("repeated", F.row_number().over(copies) > 1)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    names = RESULT.replace(",", "").split()[::2]
    schema = pa.schema([(n, pa.int64() if n in ("conv_id", *COUNTS) else pa.string()) for n in names])

    @tidy
    def run(batches):
        current = None
        for batch in batches:
            keys, *columns = (c.to_pylist() for c in batch.columns)
            done, current = _search(keys, columns, current)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, [current[0], *current[1].finish()], strict=True))], schema)

    found = map_batches(ordered, run, RESULT)
    if conversations is None:
        return found
    nothing = Search().finish()
    left = conversations.select(F.col("conv_id").cast("long").alias("__conv")).distinct()
    joined = left.join(found, F.col("__conv").eqNullSafe(F.col("conv_id")), "left")
    rest = [F.coalesce(F.col(c), F.lit(v).cast(t)).alias(c) for c, v, t in zip(names[1:], nothing, ["long"] * len(COUNTS) + ["string"] * 2, strict=True)]
    return joined.select(F.col("__conv").alias("conv_id"), *rest)
