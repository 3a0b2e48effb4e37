"""Streams of attempts: windowed counters, caches with a time to live, failure runs.

Each takes a streaming DataFrame with user_id, event_type, value and ts (TIMESTAMP), and returns one.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Attempt rows as they arrive in a folder, in Parquet files of a name or pattern."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counters(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Attempts and successes by strategy in each window; rows later than the watermark are left out."""
    windowed = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    out = windowed.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("value") >= 30).alias("successes"))
    return out.select(F.col("window.start").alias("start"), "event_type", "attempts", "successes")


def completions(stream: DataFrame, back: str = "90 days", slide: str = "1 day") -> DataFrame:
    """Domains with three or more completions within a sliding look-back."""
    n = stream.withWatermark("ts", slide).groupBy(F.window("ts", back, slide), "user_id").agg(F.count(F.lit(1)).alias("done"))
    return n.filter("done >= 3").select(F.col("window.end").alias("end"), "user_id", "done")


def first_seen(stream: DataFrame, ttl: str = "7 days") -> DataFrame:
    """One row a domain within the time to live: a cache that forgets."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["user_id"])


RUN = "user_id long, failures long, requeue boolean"


def failure_runs(stream: DataFrame, requeue_at: int = 2) -> DataFrame:
    """Consecutive failures of each domain so far, and whether it goes back to the queue."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values("ts")
        for v in rows["value"]:
            run = 0 if v >= 30 else run + 1
        state.update((run,))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [run], "requeue": [run >= requeue_at]})

    return stream.groupBy("user_id").applyInPandasWithState(update, RUN, "run long", "update", "NoTimeout")


CHANGE = "user_id long, day date, words double, was double"


def snapshot_changes(stream: DataFrame) -> DataFrame:
    """Each day's sum of a domain beside the day before it, kept up as attempts come; rows of a day that is over are left out."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        day, words, was = state.get if state.exists else (None, 0.0, None)
        rows = pd.concat(batches)
        out = {}
        for at, sum_ in rows.groupby(rows["ts"].dt.date)["value"].sum().sort_index().items():
            number = (at - date(1970, 1, 1)).days
            if day is not None and number < day:
                continue
            if number != day:
                day, words, was = number, 0.0, words if day is not None else None
            words += float(sum_)
            out[at] = words, was
        state.update((day, words, was))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "day": list(out), "words": [w for w, _ in out.values()], "was": pd.Series([w for _, w in out.values()], dtype=float)})

    return stream.groupBy("user_id").applyInPandasWithState(update, CHANGE, "day long, words double, was double", "update", "NoTimeout")


def queue(stream: DataFrame, failed_below: float = 20) -> DataFrame:
    """Failed attempts merged by domain as they come: attempts, strategies tried, first time."""
    by = stream.filter(F.col("value") < failed_below).groupBy("user_id")
    return by.agg(F.count(F.lit(1)).alias("attempts"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("tried"), F.min("ts").alias("added"))


def strategies(stream: DataFrame, success_from: float = 30) -> DataFrame:
    """Latest successful strategy of each domain as attempts come; equal times in order of event_id."""
    good = stream.filter(F.col("value") >= success_from)
    return good.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("method"), F.max("ts").alias("updated_at"))


def drain(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there into Parquet files of a shared folder, a batch a subfolder, and reads the result.

    A batch that is run again replaces its own files. In complete mode the last batch counts, in
    update mode the last row of each key.
    """
    out = f"{folder}/out"
    query = stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(out)
    if mode == "complete":
        rows = rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    elif mode == "update":
        rows = rows.groupBy(*(keys or [])).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (keys or [])]), "batch").alias("r")).select(*(keys or []), "r.*")
    return rows.drop("batch")


def freshness(due: DataFrame, crawls: DataFrame, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Each due visit (user_id, event_id, due_at) with the crawls (user_id, crawled_at) in the time before it, or none: then it has to be made.

    An interval join of two streams: the watermarks bound how long either side is held. A visit
    without a crawl comes out once no crawl in its interval can come any more; null keys have none.
    """
    left = due.withWatermark("due_at", late)
    right = crawls.withWatermark("crawled_at", late).withColumnRenamed("user_id", "crawled")
    near = F.expr(f"user_id = crawled and crawled_at <= due_at and crawled_at > due_at - interval {within}")
    return left.join(right, near, "leftOuter").select("user_id", "event_id", "due_at", "crawled_at")
