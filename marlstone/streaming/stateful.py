"""Custom state per key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_db(spark: SparkSession):
    """State in RocksDB while it lasts, as ``transformWithState`` asks for; a query takes the setting when it starts."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Milestones(StatefulProcessor):
    """Counts a user's events; the state is the count so far."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self.count.get()[0] if self.count.exists() else 0
        none_first = lambda x: (x is not None, x)
        for _, event_id in sorted(((r["ts"], r["event_id"]) for r in rows), key=lambda x: [none_first(c) for c in x]):
            n += 1
            if n % self.every == 0:
                yield Row(user_id=key[0], event_id=event_id, n=n)
        self.count.update((n,))

    def close(self) -> None:
        pass


def milestones(events: DataFrame, every: int) -> DataFrame:
    """Rows at which a user's running event count reaches a multiple of ``every``: ``user_id, event_id, n``.

    Within a batch a user's events are taken by time, then id, nulls first; only these
    two are held.  Run it within ``rocks_db``.
    """
    slim = events.select("user_id", "event_id", "ts").groupBy("user_id")
    return slim.transformWithState(Milestones(every), "user_id long, event_id long, n long", "append", "none")
