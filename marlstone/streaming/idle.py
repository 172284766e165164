"""Bursts of events, closed by event-time timers; what is closed leaves the state."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BURST = "user_id long, began timestamp, ended timestamp, n long"


#: Times that are sorted and merged with the open bursts at once.
CHUNK = 10_000


def merged(bursts: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Bursts in order, those nearer than the gap joined: one sort and one sweep."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(bursts):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Bursts(StatefulProcessor):
    """Open bursts of a user as a list of (first, last, events), in microseconds.

    A row joins the bursts that it lies nearer to than the gap, so rows may come in any
    order; some are sorted at a time and swept together with the bursts.  A user has one timer, for the burst that
    closes first; when it fires all that the watermark has closed leave together, and the next is set.
    The list holds no more bursts than fit between the watermark and the
    latest event, whatever the number of rows.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bursts = handle.getListState("bursts", "first long, last long, n long")

    def _closes(self, last: int) -> int:
        """Milliseconds of the timer: the first at which no event can come near any more."""
        return -(-last // 1000) + self.gap_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bursts = [tuple(b) for b in self.bursts.get()]
        timer = self._closes(bursts[0][1]) if bursts else None
        while chunk := [(r["us"], r["us"], 1) for r in islice(rows, CHUNK)]:
            bursts = merged(bursts + chunk, self.gap_ms * 1000)
        if not bursts:
            return iter(())
        wanted = self._closes(bursts[0][1])
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if timer != wanted:
            self.handle.registerTimer(wanted)
        self.bursts.put(bursts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rest = []
        for first, last, n in (tuple(b) for b in self.bursts.get()):
            if self._closes(last) <= at:
                yield Row(user_id=key[0], first=first, last=last, n=n)
            else:
                rest.append((first, last, n))
        if rest:
            self.bursts.put(rest)
            self.handle.registerTimer(self._closes(rest[0][1]))
        else:
            self.bursts.clear()

    def close(self) -> None:
        pass


#: Groups of users that share a state and a timer. Every group costs some calls to the state a batch, a user none.
GROUPS = 1024


class SharedBursts(Bursts):
    """As ``Bursts``, for the users of a group: their open bursts lie in one list, with one timer for the burst that closes first.

    Rows are merged so many at a time as bursts are held, ``CHUNK`` at least, so that each is merged again only a few times.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bursts = handle.getListState("bursts", "user_id long, first long, last long, n long")

    def _first(self, bursts: list[tuple]) -> int | None:
        return self._closes(min(b[2] for b in bursts)) if bursts else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = [tuple(b) for b in self.bursts.get()]
        timer, users, held = self._first(before), defaultdict(list), len(before)
        for user, *burst in before:
            users[user].append(tuple(burst))
        while chunk := [(r["user_id"], r["us"]) for r in islice(rows, max(CHUNK, held))]:
            fresh = defaultdict(list)
            for user, us in chunk:
                fresh[user].append((us, us, 1))
            for user, some in fresh.items():
                users[user] = merged(users[user] + some, self.gap_ms * 1000)
            held = sum(map(len, users.values()))
        after = [(user, *b) for user, some in users.items() for b in some]
        if not after:
            return iter(())
        wanted = self._first(after)
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if timer != wanted:
            self.handle.registerTimer(wanted)
        self.bursts.put(after)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rest = []
        for user, first, last, n in (tuple(b) for b in self.bursts.get()):
            if self._closes(last) <= at:
                yield Row(user_id=user, first=first, last=last, n=n)
            else:
                rest.append((user, first, last, n))
        if rest:
            self.bursts.put(rest)
            self.handle.registerTimer(self._first(rest))
        else:
            self.bursts.clear()


def bursts(events: DataFrame, gap_ms: int) -> DataFrame:
    """``BURST`` of every burst that the watermark has closed: events of a user less than the gap apart.

    events: ``user_id, ts`` with a watermark on ``ts``.  Rows without a time are left
    out.  Run it within ``rocks_db``.
    """
    group = F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias("users")
    slim = events.where("ts IS NOT NULL").select(group, "user_id", "ts", F.unix_micros("ts").alias("us"))
    out = slim.groupBy("users").transformWithState(SharedBursts(gap_ms), "user_id long, first long, last long, n long", "append", "EventTime")
    return out.select("user_id", F.timestamp_micros("first").alias("began"), F.timestamp_micros("last").alias("ended"), "n")
