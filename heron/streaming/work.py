"""The queue of sites that need a hand, as a stored table: add, remove, next, clear, and the log of what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from heron.streaming.keyed import KeyedTable

ENTRY = "domain string, added timestamp, reason string, said_at timestamp, tried array<string>, again long, tier int, priority string"
DONE = "domain string, completed timestamp, pages long, words long"
#: Ranks of priorities; others rank as normal.
RANKS = {"high": 0, "normal": 1, "low": 2}


def _queued(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old entries with new failures (domain, at, reason, tried, tier) merged in: the first sets tier and age, each further one counts, the last gives the reason."""
    held = old.select("domain", "added", "reason", "said_at", "tried", (F.col("again") + 1).alias("n"), "tier")
    fresh = new.select("domain", F.col("at").alias("added"), "reason", F.col("at").alias("said_at"), F.coalesce("tried", F.array().cast("array<string>")).alias("tried"), F.lit(1).cast("long").alias("n"), "tier")
    by = held.unionByName(fresh).groupBy("domain")
    # an entry's own time is that of its first failure, so what is held comes before what is new
    out = by.agg(F.min("added").alias("added"), F.max(F.struct("said_at", "reason")).alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tried")))).alias("tried"), (F.sum("n") - 1).alias("again"), F.min(F.struct("added", F.coalesce("tier", F.lit(2**31 - 1)).alias("tier")))["tier"].alias("tier"))
    tier = F.when(F.col("tier") < 2**31 - 1, F.col("tier"))
    return out.select("domain", "added", "last.reason", "last.said_at", "tried", "again", tier.alias("tier"), F.when(F.col("tier") == 1, "high").otherwise("normal").alias("priority"))


class WorkQueue:
    """Entries by domain and a log of completed ones, both in one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.entries = KeyedTable(spark, f"{folder}/queue", ENTRY, ["domain"], buckets)
        self.completed = KeyedTable(spark, f"{folder}/completed", DONE, ["domain"], buckets)

    def add(self, failures: DataFrame, writer: str = "add", batch: int | None = None) -> None:
        """Merges failures (domain, at, reason, tried, tier) into the queue."""
        self.entries.merge(failures, _queued, writer, batch)

    def remove(self, done: DataFrame, writer: str = "remove", batch: int | None = None) -> None:
        """Takes the domains of done (domain, completed, pages, words) off the queue and logs them, those not queued too."""
        rows = done.select("domain", "completed", "pages", "words")
        self.completed.merge(rows, lambda old, new: old.unionByName(new), writer, batch)  # logged first: run again, it is logged once
        self.entries.merge(rows, lambda old, new: old.join(new.select(F.col("domain").alias("_gone")).distinct(), F.col("domain").eqNullSafe(F.col("_gone")), "left_anti"), writer, batch)

    def listed(self) -> DataFrame:
        return self.entries.read()

    def next(self) -> Row | None:
        """The entry to work on: by rank, then age, then name."""
        ranks = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
        found = self.listed().orderBy(F.coalesce(F.try_element_at(ranks, F.col("priority")), F.lit(1)), "added", "domain").limit(1).collect()
        return found[0] if found else None

    def clear(self) -> int:
        """Empties the queue, not the log; how many entries it had."""
        return self.entries.clear()

    def perpetual(self, now, days: int = 90, least: int = 3) -> DataFrame:
        """Domains completed by hand `least` times in the days before now."""
        since = self.completed.read().filter(F.col("completed") > F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
        return since.groupBy("domain").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= least)
