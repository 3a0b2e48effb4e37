"""Streams with a time to live, and the queue as a stored table that streams merge into."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.exprs import Registry
from heron.plans.access import DONE, read
from heron.session import folder as _folder
from heron.streaming import caches, keyed, telemetry, work

R = Registry()


@R.add("stream_strategy_cache", """with e as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events),
 s as (select *, sum(case when before is null or ts - before > interval 1 day then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from e)
 select event_id, user_id, last_value(case when value >= 30 then event_type end ignore nulls) over w as cached, last_value(case when value >= 30 then null else event_type end ignore nulls) over w as failed, last_value(case when value >= 30 then event_type end ignore nulls) over w is not null as hit
 from s window w as (partition by user_id, run order by ts, event_id rows between unbounded preceding and 1 preceding)""")
def stream_strategy_cache(spark, sf_dir):
    """What a cache that forgets after a day says before each attempt: the method that last worked, the one that last failed."""
    return telemetry.drain(caches.strategy_lookups(telemetry.events(caches.session(spark), sf_dir), caches.DAY), _folder(spark))


@R.add("stream_probe_cache", """with recursive e as (select user_id, event_id, ts, value, row_number() over (partition by user_id order by ts, event_id) as n from events),
 nxt as (select a.user_id, a.n, min(b.n) as m from e a join e b on a.user_id = b.user_id and b.n > a.n and b.ts >= a.ts + case when a.value >= 20 then interval 7 day else interval 1 day end group by all),
 f as (select user_id, n from e where n = 1 union all select nxt.user_id, nxt.m from f join nxt on f.user_id = nxt.user_id and f.n = nxt.n)
 select e.user_id, e.event_id, f.n is not null as fetched, epoch_us(last_value(case when f.n is not null then e.ts end ignore nulls) over (partition by e.user_id order by e.n rows between unbounded preceding and current row)) as fetched_at from e left join f on e.user_id = f.user_id and e.n = f.n""")
def stream_probe_cache(spark, sf_dir):
    """Which requests of a site's probe are fetched anew: results live seven days, failed ones a day."""
    return telemetry.drain(caches.probe_lookups(telemetry.events(caches.session(spark), sf_dir)), _folder(spark))


@R.add("stream_failure_runs", """with e as (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events),
 s as (select *, sum(case when before is null or ts - before > interval 1 day then 1 else 0 end) over (partition by user_id order by ts, event_id) as run from e),
 g as (select *, sum(cast(value >= 30 as int)) over (partition by user_id, run order by ts, event_id) as good from s),
 f as (select event_id, user_id, count(*) filter (where not value >= 30) over (partition by user_id, run, good order by ts, event_id rows between unbounded preceding and current row) as failures from g)
 select event_id, user_id, failures, failures >= 2 as requeue from f""")
def stream_failure_runs(spark, sf_dir):
    """Failures in a row up to each attempt, forgotten a day after the last one."""
    return telemetry.drain(caches.failure_runs(telemetry.events(caches.session(spark), sf_dir), caches.DAY), _folder(spark))


def failures(events):
    """domain, at, reason, tried, tier of failed attempts."""
    return events.filter("value < 20").select(F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit(".org")).alias("domain"), F.col("ts").cast("timestamp").alias("at"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("reason"), F.array("event_type").alias("tried"), F.when(F.col("user_id") % 3 == 0, 1).otherwise(2).alias("tier"))


def filled(spark, sf_dir) -> work.WorkQueue:
    """A queue that the stream of failed attempts has been merged into, one batch of it twice."""
    folder = _folder(spark)
    queue = work.WorkQueue(spark, folder, 16)
    for attempt in range(2):  # the second run has lost its checkpoint
        keyed.into(failures(telemetry.events(spark, sf_dir)), queue.entries, work._queued, f"{folder}/state{attempt}", "failures")
    return queue


_QUEUED = "(select 'd' || user_id || '.org' as domain, min(ts) as added, arg_max(event_type || ':' || event_id, (ts, event_id)) as reason, array_to_string(list_sort(list_distinct(list(event_type))), ',') as tried, count(*) - 1 as again, case when user_id % 3 = 0 then 'high' else 'normal' end as priority from events where value < 20 group by user_id)"
_FINISHED = f"(select 'd' || user_id || '.org' as domain, count(*) as times from events where {DONE} group by user_id)"


@R.add("queue_table", f"select * from {_QUEUED} where domain not in (select domain from {_FINISHED})")
def queue_table(spark, sf_dir):
    """The stored queue after its stream and after what is done was taken off."""
    queue = filled(spark, sf_dir)
    queue.remove(finished(spark, sf_dir), batch=0)
    return queue.listed().select("domain", F.col("added").cast("timestamp_ntz").alias("added"), "reason", F.array_join("tried", ",").alias("tried"), "again", "priority")


def finished(spark, sf_dir):
    """domain, completed, pages, words of the work that was done."""
    return read(spark, sf_dir, "events").filter(DONE).select(F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit(".org")).alias("domain"), F.col("ts").cast("timestamp").alias("completed"), F.lit(1).cast("long").alias("pages"), F.col("value").cast("long").alias("words"))


@R.add("queue_log", f"select domain, times from {_FINISHED}")
def queue_log(spark, sf_dir):
    """How often each domain was completed, by the log, which a batch that is run twice enters once."""
    queue = work.WorkQueue(spark, _folder(spark), 16)
    for _ in range(2):
        queue.remove(finished(spark, sf_dir), batch=0)
    return queue.completed.read().groupBy("domain").agg(F.count(F.lit(1)).alias("times"))


@R.add("queue_first", f"select domain, added from {_QUEUED} where domain not in (select domain from {_FINISHED}) order by priority <> 'high', added, domain limit 1")
def queue_first(spark, sf_dir):
    """The stored queue's next entry."""
    queue = filled(spark, sf_dir)
    queue.remove(finished(spark, sf_dir))
    found = queue.next()
    return spark.createDataFrame([(found["domain"], found["added"])] if found else [], "domain string, added timestamp").select("domain", F.col("added").cast("timestamp_ntz").alias("added"))
