"""Caches with a time to live as streams: state that forgets by event-time timers.

Each key's entry carries a timer for the moment at which it is too old. When the watermark passes it
the entry leaves the state, so state holds the keys of one time to live and not of all time. Rows of
a key are taken in order of ts and event_id; an entry that is too old counts as none even before its
timer fires, so the answers don't depend on how rows fall into batches as long as they come in order.

Cases: rows later than the watermark are left out, as in any stream; null keys are a key; rows that
repeat are rows of their own. A null value is no success and a failed probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from heron.session import ship

DAY = 86_400_000_000
LOOKED = "user_id long, event_id long, cached string, failed string, hit boolean"
RUNS = "user_id long, event_id long, failures long, requeue boolean"
PROBED = "user_id long, event_id long, fetched boolean, fetched_at long"
_KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


def session(spark: SparkSession) -> SparkSession:
    """A session beside the user's own, whose streams keep their state in RocksDB; nothing of the user's is set."""
    own = spark.newSession()
    for name in _KEPT:
        if (held := spark.conf.get(name, None)) is not None:
            own.conf.set(name, held)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class Forgetful(StatefulProcessor):
    """One entry for each key, which leaves the state once `until` says that it is too old."""

    schema: str

    def init(self, handle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", self.schema)

    def until(self, held: tuple) -> int:
        """Microseconds from which on the entry is none."""
        raise NotImplementedError

    def answer(self, held: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        """The entry after a row (event_id, event_type, value, at), and what is said of the row."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values(["at", "event_id"])
        held = tuple(self.entry.get()) if self.entry.exists() else None
        said = []
        for row in batch[["event_id", "event_type", "value", "at"]].itertuples(index=False, name=None):
            if held is not None and row[3] >= self.until(held):
                held = None
            held, told = self.answer(held, row)
            said.append((key[0], row[0], *told))
        self.entry.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-self.until(held) // 1000))
        yield pd.DataFrame(said, columns=[c.split()[0] for c in self.output.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


class Strategies(Forgetful):
    """The method that last worked and the one that last failed; every attempt renews the entry."""

    schema, output = "method string, failed string, updated long", LOOKED

    def __init__(self, ttl: int, success_from: float) -> None:
        self.ttl, self.success_from = ttl, success_from

    def until(self, held: tuple) -> int:
        return held[2] + self.ttl + 1  # of exactly that age it still counts

    def answer(self, held: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        method, failed, updated = held or (None, None, row[3])
        told = method, failed, method is not None
        good = row[2] is not None and row[2] >= self.success_from
        return (row[1] if good else method, failed if good else row[1], max(updated, row[3])), told


class Probes(Forgetful):
    """When a site was last probed; an entry isn't renewed by being read, and a failed probe lives shorter."""

    schema, output = "fetched long, error boolean", PROBED

    def __init__(self, ttl: int, error_ttl: int, error_below: float) -> None:
        self.ttl, self.error_ttl, self.error_below = ttl, error_ttl, error_below

    def until(self, held: tuple) -> int:
        return held[0] + (self.error_ttl if held[1] else self.ttl)

    def answer(self, held: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        fetched = held is None
        held = held or (row[3], not (row[2] is not None and row[2] >= self.error_below))
        return held, (fetched, held[0])


class Failures(Forgetful):
    """Failures in a row up to each attempt; a domain that is not heard of for the time to live begins anew."""

    schema, output = "run long, updated long", RUNS

    def __init__(self, ttl: int, success_from: float, requeue_at: int) -> None:
        self.ttl, self.success_from, self.requeue_at = ttl, success_from, requeue_at

    def until(self, held: tuple) -> int:
        return held[1] + self.ttl + 1

    def answer(self, held: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        run, updated = held or (0, row[3])
        run = 0 if row[2] is not None and row[2] >= self.success_from else run + 1
        return (run, max(updated, row[3])), (run, run >= self.requeue_at)


def _run(stream: DataFrame, processor: Forgetful, late: str) -> DataFrame:
    ship(stream.sparkSession)
    rows = stream.select("user_id", "event_id", "event_type", "value", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(processor, processor.output, "append", "eventTime")


def strategy_lookups(stream: DataFrame, ttl: int = 30 * DAY, success_from: float = 30, late: str = "1 day") -> DataFrame:
    """What the cache of strategies says before each attempt (user_id, event_id, event_type, value, ts). ttl: microseconds."""
    return _run(stream, Strategies(ttl, success_from), late)


def probe_lookups(stream: DataFrame, ttl: int = 7 * DAY, error_ttl: int = DAY, error_below: float = 20, late: str = "1 day") -> DataFrame:
    """Whether each request of a site's probe has to be fetched anew, and when what it gets was fetched."""
    return _run(stream, Probes(ttl, error_ttl, error_below), late)


def failure_runs(stream: DataFrame, ttl: int = 30 * DAY, success_from: float = 30, requeue_at: int = 2, late: str = "1 day") -> DataFrame:
    """Failures in a row up to each attempt, and whether the domain goes back to the queue."""
    return _run(stream, Failures(ttl, success_from, requeue_at), late)
