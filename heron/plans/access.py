"""Joins and operational reports: seeds, freshness, access metrics, drift, queues and caches.

The events table stands for attempt telemetry: user_id as domain, event_type as strategy, value as
words. "Now" is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heron.exprs import Registry
from heron.functions import flows, policy, urls
from heron.plans.urls import HOST, P
from heron.session import folder
from heron.streaming import keyed

R = Registry()
NOW = "2024-02-01 00:00:00"


def success():
    return F.col("value") >= 30


def read(spark, sf_dir, name) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def age_days(now: str, ts):
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts)) / 86400e6


OUTCOME = "case when value >= 30 then 'success_real_content' when value >= 20 then 'soft_block' when value >= 10 then 'hard_block' when value >= 5 then 'challenge_not_cleared' else 'timeout' end"


def outcome():
    v = F.col("value")
    return F.when(v >= 30, "success_real_content").when(v >= 20, "soft_block").when(v >= 10, "hard_block").when(v >= 5, "challenge_not_cleared").otherwise("timeout")


@R.add("access_by_tier", f"""select c_nationkey % 3 + 1 as tier, count(*) as seeds, count(*) filter (where user_id is null) as missing, count(*) filter (where value >= 30) as success, count(*) filter (where value between 10 and 19.999999) as blocked,
 count(*) filter (where value >= 30) / cast(count(*) as double) as success_rate from customer left join (select user_id, arg_max(value, (ts, event_id)) as value from events group by user_id) on c_custkey = user_id group by 1""")
def access_by_tier(spark, sf_dir):
    """Seeds with their latest attempt: a left join, so that seeds never tried count as missing."""
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    seeds = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3 + 1).alias("tier"))
    j = seeds.join(last, seeds.c_custkey == last.user_id, "left")
    return j.groupBy("tier").agg(F.count(F.lit(1)).alias("seeds"), F.count_if(F.col("user_id").isNull()).alias("missing"), F.count_if(success()).alias("success"), F.count_if(F.col("value").between(10, 19.999999)).alias("blocked"), (F.count_if(success()) / F.count(F.lit(1))).alias("success_rate"))


@R.add("access_metrics", f"""select unnest(['success_rate', 'block_rate', 'http_efficiency', 'soft_block_rate', 'challenge_rate', 'attempts_per_domain']) as metric, unnest([s / n, b / n, h / n, f / n, c / n, n / d]) as value from
 (select cast(count(*) as double) as n, count(*) filter (where value >= 30) as s, count(*) filter (where {OUTCOME} = 'hard_block') as b, count(*) filter (where event_type = 'view') as h, count(*) filter (where {OUTCOME} = 'soft_block') as f, count(*) filter (where {OUTCOME} = 'challenge_not_cleared') as c, count(distinct user_id) as d from events)""")
def access_metrics(spark, sf_dir):
    """Ratios as rows; a ratio of nothing is null."""
    e = read(spark, sf_dir, "events").withColumn("outcome", outcome())
    n = F.count(F.lit(1))
    share = lambda c: F.try_divide(F.count_if(c), n)
    o = F.col("outcome")
    wide = e.agg(share(success()).alias("success_rate"), share(o == "hard_block").alias("block_rate"), share(F.col("event_type") == "view").alias("http_efficiency"), share(o == "soft_block").alias("soft_block_rate"), share(o == "challenge_not_cleared").alias("challenge_rate"), F.try_divide(n, F.count_distinct("user_id")).alias("attempts_per_domain"))
    return wide.unpivot([], wide.columns, "metric", "value")


@R.add("access_summary", f"select user_id, count(*) as attempts, count(distinct event_type) as strategies, case when count(distinct event_type) = 0 then 'unknown' when count(distinct event_type) = 1 then min(event_type) else 'mixed' end as fetch_method, round_even(avg(case when value >= 30 then 1.0 else 0.0 end), 3) as success_rate, greatest(0, count(*) - count(*) filter (where value >= 30)) as failed, count(*) filter (where {OUTCOME} = 'timeout') as timeouts from events group by user_id")
def access_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("outcome", outcome())
    k = F.count_distinct("event_type")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), k.alias("strategies"), F.when(k == 0, "unknown").when(k == 1, F.min("event_type")).otherwise("mixed").alias("fetch_method"), F.bround(F.avg(success().cast("double")), 3).alias("success_rate"), F.greatest(F.lit(0), F.count(F.lit(1)) - F.count_if(success())).alias("failed"), F.count_if(F.col("outcome") == "timeout").alias("timeouts"))


@R.add("access_freshness", f"select case when age <= 2 then 'fresh' when age > 2 then 'stale' else 'missing' end as state, count(*) as domains from (select c_custkey, (epoch_us(timestamp '{NOW}') - epoch_us(last)) / 86400e6 as age from customer left join (select user_id, max(ts) as last from events group by user_id) on c_custkey = user_id) group by 1")
def access_freshness(spark, sf_dir):
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    seeds = read(spark, sf_dir, "customer").select("c_custkey")
    aged = seeds.join(last, seeds.c_custkey == last.user_id, "left").withColumn("age", age_days(NOW, F.col("last")))
    return aged.groupBy(F.when(F.col("age") <= 2, "fresh").when(F.col("age") > 2, "stale").otherwise("missing").alias("state")).agg(F.count(F.lit(1)).alias("domains"))


@R.add("seeds_due", f"select c_custkey from customer where c_mktsegment in ('BUILDING', 'AUTOMOBILE') and c_custkey not in (select user_id from events where ts > timestamp '{NOW}' - interval 5 day and value >= 30)")
def seeds_due(spark, sf_dir):
    """Seeds of two categories without a fresh success: a filter that reaches the scan, then an anti join."""
    fresh = read(spark, sf_dir, "events").filter((F.col("ts") > F.expr(f"timestamp '{NOW}' - interval 5 days")) & success()).select("user_id")
    seeds = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).select("c_custkey")
    return seeds.join(fresh, seeds.c_custkey == fresh.user_id, "left_anti")


@R.add("seeds_limited", "select c_custkey, c_name from customer where c_nationkey = 3 order by c_custkey limit 10")
def seeds_limited(spark, sf_dir):
    """The first ten seeds of a tier, in file order."""
    return read(spark, sf_dir, "customer").filter("c_nationkey = 3").orderBy("c_custkey").limit(10).select("c_custkey", "c_name")


SNAP = "(select user_id, cast(ts as date) as day, sum(value) as words, count(*) as pages, max(event_type) as strategy, max(value) < 60 as blocked from events group by 1, 2)"


@R.add("drift", f"""select user_id, day, change, strategy <> was_strategy as strategy_changed, array_to_string(list_filter([case when change < -0.3 then case when change < -0.5 then 'content_drop:high' else 'content_drop:medium' end when change > 0.3 then 'content_increase:low' end, case when strategy <> was_strategy then case when coalesce(change, 0) < -0.3 then 'access_degradation:high' else 'strategy_change:low' end end,
 case when not was_blocked and blocked then 'new_block:high' when was_blocked and not blocked then 'block_resolved:low' end], lambda x: x is not null), ',') as alerts from (select *, case when was > 0 then (words - was) / was end as change from (select *, lag(words) over w as was, lag(strategy) over w as was_strategy, lag(blocked) over w as was_blocked from {SNAP} window w as (partition by user_id order by day)) where was_strategy is not null)""")
def drift(spark, sf_dir):
    """Daily snapshots of each domain against the one before; a change from nothing is null."""
    # sums of doubles hang on their order: each is taken in order of event_id, however the rows are dealt
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).select("user_id", "day", "event_id", "value", "event_type")
    e = e.repartition("user_id", "day").sortWithinPartitions("user_id", "day", "event_id", "value")
    snap = e.groupBy("user_id", "day").agg(F.sum("value").alias("words"), F.count(F.lit(1)).alias("pages"), F.max("event_type").alias("strategy"), (F.max("value") < 60).alias("blocked"))
    w = Window.partitionBy("user_id").orderBy("day")
    both = snap.withColumns({"was": F.lag("words").over(w), "was_strategy": F.lag("strategy").over(w), "was_blocked": F.lag("blocked").over(w)}).filter("was_strategy is not null")
    both = both.withColumn("change", F.when(F.col("was") > 0, (F.col("words") - F.col("was")) / F.col("was")))
    c, moved = F.col("change"), F.col("strategy") != F.col("was_strategy")
    alerts = F.array(
        F.when(c < -0.5, "content_drop:high").when(c < -0.3, "content_drop:medium").when(c > 0.3, "content_increase:low"),
        F.when(moved & (F.coalesce(c, F.lit(0.0)) < -0.3), "access_degradation:high").when(moved, "strategy_change:low"),
        F.when(~F.col("was_blocked") & F.col("blocked"), "new_block:high").when(F.col("was_blocked") & ~F.col("blocked"), "block_resolved:low"),
    )
    return both.select("user_id", "day", "change", moved.alias("strategy_changed"), F.array_join(F.filter(alerts, lambda a: a.isNotNull()), ",").alias("alerts"))


@R.add("drift_top", f"select user_id, day, change from (select user_id, day, case when was > 0 then (words - was) / was end as change from (select *, lag(words) over (partition by user_id order by day) as was from {SNAP})) where change is not null order by abs(change) desc, user_id, day limit 15")
def drift_top(spark, sf_dir):
    """The fifteen largest changes."""
    return drift(spark, sf_dir).filter("change is not null").orderBy(F.desc(F.abs("change")), "user_id", "day").limit(15).select("user_id", "day", "change")


@R.add("drift_pages", "select user_id, len(list_filter(a, lambda x: not list_contains(b, x))) as missing, len(list_filter(b, lambda x: not list_contains(a, x))) as added from (select user_id, coalesce(list_distinct(list(event_type) filter (where ts < timestamp '2024-01-16')), []) as a, coalesce(list_distinct(list(event_type) filter (where ts >= timestamp '2024-01-16' and value > 50)), []) as b from events group by user_id)")
def drift_pages(spark, sf_dir):
    """Pages missing from and added to the later half, as set differences both ways."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(~late, F.col("event_type"))).alias("a"), F.collect_set(F.when(late & (F.col("value") > 50), F.col("event_type"))).alias("b"))
    return e.select("user_id", F.size(F.array_except("a", "b")).cast("long").alias("missing"), F.size(F.array_except("b", "a")).cast("long").alias("added"))


BAND = "cast(floor(value / 10) as bigint)"


@R.add("report_diff", f"with e as (select user_id, event_type, {BAND} as band, ts >= timestamp '2024-01-16' as late from events), n as (select distinct user_id, event_type, band from e where late), o as (select distinct user_id, event_type, band from e where not late) select 'added' as side, * from (select * from n except select * from o) union all select 'removed', * from (select * from o except select * from n) where user_id in (select user_id from n)")
def report_diff(spark, sf_dir):
    """Rows added and removed between two reports, of the domains in the new one: anti joins both ways."""
    e = read(spark, sf_dir, "events").withColumn("band", F.floor(F.col("value") / 10))
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    keys = ["user_id", "event_type", "band"]
    new, old = (e.filter(c).select(*keys).distinct() for c in (late, ~late))
    removed = old.join(new, keys, "left_anti").join(new.select("user_id").distinct(), "user_id", "left_semi")
    return new.join(old, keys, "left_anti").withColumn("side", F.lit("added")).unionByName(removed.withColumn("side", F.lit("removed")))


@R.add("queue_upsert", "select user_id, count(*) as attempts, array_to_string(list_sort(list_distinct(list(event_type))), ',') as tried, min(ts) as added, case when user_id % 3 = 0 then 'high' else 'normal' end as priority from events where value < 20 group by user_id")
def queue_upsert(spark, sf_dir):
    """Failed attempts merged by domain: attempts counted, strategies united, first time kept."""
    e = read(spark, sf_dir, "events").filter("value < 20")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("tried"), F.min("ts").cast("timestamp_ntz").alias("added")).withColumn("priority", F.when(F.col("user_id") % 3 == 0, "high").otherwise("normal"))


@R.add("queue_next", "select user_id, added from (select user_id, min(ts) as added from events where value < 20 group by user_id) order by user_id % 3 <> 0, added, user_id limit 1")
def queue_next(spark, sf_dir):
    """The entry to work on next: by rank, then age."""
    return queue_upsert(spark, sf_dir).orderBy(F.col("priority") != "high", "added", "user_id").limit(1).select("user_id", "added")


#: Work that was done by hand after it had been queued: a purchase of a high value in the last days.
DONE = "event_type = 'purchase' and value >= 60 and ts >= timestamp '2024-01-25'"


@R.add("queue_remaining", f"select distinct user_id from events where value < 20 and user_id not in (select user_id from events where {DONE})")
def queue_remaining(spark, sf_dir):
    """The queue without the domains whose work is done."""
    done = read(spark, sf_dir, "events").filter(DONE).select("user_id").distinct()
    return queue_upsert(spark, sf_dir).select("user_id").join(done, "user_id", "left_anti")


@R.add("queue_cleared", "select count(distinct user_id) as cleared, 0 as remaining from events where value < 20")
def queue_cleared(spark, sf_dir):
    """A stored queue emptied, how many entries it had, and how many are left in it."""
    table = keyed.KeyedTable(spark, folder(spark), "user_id long, attempts long", ["user_id"], 16)
    table.merge(queue_upsert(spark, sf_dir).select("user_id", "attempts"), lambda old, new: old.unionByName(new))
    cleared = table.clear()
    return table.read().agg(F.lit(cleared).cast("long").alias("cleared"), F.count(F.lit(1)).cast("int").alias("remaining"))


@R.add("manual_always", f"select user_id, count(*) filter (where ts > timestamp '{NOW}' - interval 10 day) as recent, count(*) filter (where ts > timestamp '{NOW}' - interval 10 day) >= 3 as always from events where event_type = 'purchase' group by user_id")
def manual_always(spark, sf_dir):
    """Domains completed by hand three times in the look-back."""
    e = read(spark, sf_dir, "events").filter("event_type = 'purchase'")
    n = F.count_if(F.col("ts") > F.expr(f"timestamp '{NOW}' - interval 10 days"))
    return e.groupBy("user_id").agg(n.alias("recent"), (n >= 3).alias("always"))


CADENCE = {"daily": 1, "weekly": 7, "monthly": 30, "quarterly": 90}


@R.add("replays_due", f"select user_id, cadence, days from (select user_id, ['daily', 'weekly', 'monthly', 'quarterly', 'odd'][1 + user_id % 5] as cadence, cast(floor((epoch_us(timestamp '{NOW}') - epoch_us(max(ts))) / 86400e6) as bigint) as days from events group by user_id) where days >= case cadence when 'daily' then 1 when 'weekly' then 7 when 'quarterly' then 90 else 30 end")
def replays_due(spark, sf_dir):
    """Schedules whose last run is a cadence of whole days ago; unknown cadences are monthly."""
    names = F.array(*map(F.lit, [*CADENCE, "odd"]))
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", F.get(names, (F.col("user_id") % 5).cast("int")).alias("cadence"), F.floor(age_days(NOW, F.col("last"))).alias("days"))
    every = F.create_map(*(F.lit(x) for kv in CADENCE.items() for x in kv))
    return last.filter(F.col("days") >= F.coalesce(F.element_at(every, F.col("cadence")), F.lit(30)))


@R.add("strategy_cache", f"select user_id, arg_max(event_type, (ts, event_id)) filter (where value >= 30) as method, max(ts) as updated_at from events group by user_id having max(ts) > timestamp '{NOW}' - interval 30 day")
def strategy_cache(spark, sf_dir):
    """Latest successful strategy of each domain, forgotten after thirty days."""
    best = F.max_by(F.when(success(), F.col("event_type")), F.when(success(), F.struct("ts", "event_id")))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(best.alias("method"), F.max("ts").cast("timestamp_ntz").alias("updated_at")).filter(F.col("updated_at") > F.expr(f"timestamp_ntz '{NOW}' - interval 30 days"))


@R.add("recon_cache", f"select event_id, ts > timestamp '{NOW}' - case when value < 20 then interval 1 day else interval 7 day end as valid from events")
def recon_cache(spark, sf_dir):
    """Probe results live a week, failed ones a day."""
    keep = F.when(F.col("value") < 20, F.expr("interval 1 days")).otherwise(F.expr("interval 7 days"))
    return read(spark, sf_dir, "events").select("event_id", (F.col("ts") > F.lit(NOW).cast("timestamp") - keep).alias("valid"))


COOKIES = "(values (1, 'a', 1000.0), (1, 'b', -1.0), (2, 'c', 5.0), (3, 'd', null), (3, 'e', 700000.0)) as t(domain, name, expires)"


@R.add("cookie_status", f"select domain, count(*) as cookies, count(*) filter (where expires is null or expires <= 0 or expires >= 100) as valid, min(expires) filter (where expires > 0) as earliest, case when min(expires) filter (where expires > 0) is null then 'session' when min(expires) filter (where expires > 0) < 100 then 'EXPIRED' when min(expires) filter (where expires > 0) - 100 <= 604800 then 'expiring' else 'ok' end as status from {COOKIES} group by domain")
def cookie_status(spark, sf_dir):
    """Earliest positive expiry against a given time (100)."""
    c = spark.sql(f"select domain, name, cast(expires as double) as expires from {COOKIES}")
    first = F.min(F.when(F.col("expires") > 0, F.col("expires")))
    valid = F.count_if(F.col("expires").isNull() | (F.col("expires") <= 0) | (F.col("expires") >= 100))
    return c.groupBy("domain").agg(F.count(F.lit(1)).alias("cookies"), valid.alias("valid"), first.alias("earliest"), F.when(first.isNull(), "session").when(first < 100, "EXPIRED").when(first - 100 <= 604800, "expiring").otherwise("ok").alias("status"))


KINDS = {"view": "navigate", "click": "click", "purchase": "scroll", "signup": "type"}


@R.add("flow_signature", """select event_id, case event_type when 'view' then 'navigate:https://a.example/' || user_id % 7 when 'click' then 'click:(' || cast(round_even(user_id / 50.0, 0) * 50 as bigint) || ',' || cast(round_even(event_id / 50.0, 0) * 50 as bigint) || '):' || substr('div.product-list-item-of-the-page-' || user_id, 1, 30) || ':' || substr('A label of the item ' || event_id, 1, 20)
 when 'purchase' then 'scroll:down:' || event_id % 9 when 'signup' then 'type:text ' || event_id % 5 else event_type end as signature from events""")
def flow_signature(spark, sf_dir):
    """Keys of actions of every kind: an address, a place on a grid of fifty with the start of selector and label, a scroll, a text."""
    n, u = F.col("event_id"), F.col("user_id")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type")), F.col("event_type"))
    said = lambda t, c: F.concat(F.lit(t), c.cast("string"))
    a = F.struct(kind.alias("action"), said("https://a.example/", u % 7).alias("url"), said("div.product-list-item-of-the-page-", u).alias("selector"), said("text ", n % 5).alias("text"), said("A label of the item ", n).alias("label"), F.lit("down").alias("direction"), (n % 9).alias("amount"), u.cast("double").alias("x"), n.cast("double").alias("y"))
    return read(spark, sf_dir, "events").select("event_id", a.alias("a")).select("event_id", flows.signature(F.col("a")).alias("signature"))


@R.add("flow_checks", "select conv_id, count(*) as actions, count(*) filter (where text is null or role is null) as errors, case when sum(len(text)) < 100 and count(*) > 5 then 'too fast' end as warning, count(*) filter (where role = 'system') = 0 as no_start from conversations group by conv_id")
def flow_checks(spark, sf_dir):
    """Row-level constraints of recorded sequences, with warnings on the whole."""
    c = read(spark, sf_dir, "conversations")
    n = F.count(F.lit(1))
    return c.groupBy("conv_id").agg(n.alias("actions"), F.count_if(F.col("text").isNull() | F.col("role").isNull()).alias("errors"), F.when((F.sum(F.length("text")) < 100) & (n > 5), "too fast").alias("warning"), (F.count_if(F.col("role") == "system") == 0).alias("no_start"))


@R.add("flow_compare", "with t as (select conv_id, count(*) as n, sum(coalesce(turn, 0) % 3) as secs from conversations group by conv_id) select a.conv_id, a.n as actions, a.n as same, 1 as added, 0 as removed, 1.0::double as timing_diff, 2.0::double * a.n / (2 * a.n + 1) as similarity from t a")
def flow_compare(spark, sf_dir):
    """Every conversation as a flow against itself with one more step at its end: what matches, was added and removed."""
    c = read(spark, sf_dir, "conversations")
    step = F.struct(F.lit("type").alias("action"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("selector"), F.concat_ws(":", F.col("turn").cast("string"), "role", "text").alias("text"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("long").alias("amount"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), (F.coalesce("turn", F.lit(0)) % 3).cast("double").alias("delay"))
    one = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", step.alias("step")))), lambda s: s["step"]).alias("a"))
    more = F.from_json(F.lit('{"action": "navigate", "url": "https://a.example/", "delay": 1.0}'), flows.ACTION)
    d = one.select("conv_id", "a", F.concat("a", F.array(more)).alias("b")).select("conv_id", F.size("a").cast("long").alias("actions"), flows.compared(F.col("a"), F.col("b")).alias("d"))
    return d.select("conv_id", "actions", F.col("d.matching").alias("same"), F.size("d.added").alias("added"), F.size("d.removed").alias("removed"), "d.timing_diff", "d.similarity")


@R.add("sample_strata", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by sha256(doc_id || ':7'), doc_id) as r from documents) where r <= 3")
def sample_strata(spark, sf_dir):
    """Three documents of each source, in an order that a seed fixes."""
    w = Window.partitionBy("source").orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":7")), 256), "doc_id")
    return read(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("r")).filter("r <= 3").drop("r")


@R.add("sample_exclusive", "with r as (select doc_id from documents order by sha256(doc_id || ':1'), doc_id limit 10), t as (select doc_id from documents where lang = 'fr' and doc_id not in (select doc_id from r) order by sha256(doc_id || ':2'), doc_id limit 5), e as (select doc_id from documents where lang = 'de' and doc_id not in (select doc_id from r) and doc_id not in (select doc_id from t) order by sha256(doc_id || ':3'), doc_id limit 4) select doc_id, 'random' as stratum from r union all select doc_id, 'targeted' from t union all select doc_id, 'edge_case' from e")
def sample_exclusive(spark, sf_dir):
    """Strata that don't overlap: random ones, then targeted ones, then edge cases."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    by = lambda seed: F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(seed)), 256)
    held = None
    for name, cond, seed, n in (("random", F.lit(True), ":1", 10), ("targeted", F.col("lang") == "fr", ":2", 5), ("edge_case", F.col("lang") == "de", ":3", 4)):
        rest = d if held is None else d.join(held.select("doc_id"), "doc_id", "left_anti")
        some = rest.filter(cond).orderBy(by(seed), "doc_id").limit(n).select("doc_id", F.lit(name).alias("stratum"))
        held = some if held is None else held.unionByName(some)
    return held


@R.add("access_plans", f"""select event_id, case when event_id % 11 = 0 then 'visible' when n <> 'requests' then n when event_id % 7 = 1 then 'stealth' when event_id % 7 in (2, 3) then 'js' else n end as initial_strategy, case when event_id % 13 = 0 then 5 when event_id % 3 = 1 then 4 else 3 end as max_attempts, case when event_id % 11 = 1 then 0 else 3 end as max_escalations,
 coalesce(case when event_id % 5 = 3 then event_id % 2 = 0 end, event_id % 3 = 1 or event_id % 5 = 2) or (n = 'requests' and event_id % 7 = 1) as patient_mode, case when event_id % 5 = 1 then 10.0 when event_id % 3 = 1 then 5.0 else 3.0 end::double as delay_seconds, event_id % 5 <> 4 as allow_stealth, event_id % 3 = 2 as allow_visible
 from (select event_id, case event_id % 5 when 1 then 'js' when 2 then 'stealth' else case event_id % 3 when 1 then 'stealth' when 2 then 'visible' else 'requests' end end as n from events)""")
def access_plans(spark, sf_dir):
    """Plans from playbook, fetch spec, probe and overrides in every combination."""
    n = F.col("event_id")
    held = lambda **kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for kv in kv.items() for x in kv))
    playbook = F.when(n % 3 == 1, held(strategy="playwright_stealth", patient="true", delay="5", max_attempts="4")).when(n % 3 == 2, held(strategy="manual"))
    spec = F.when(n % 5 == 1, held(method="playwright", delay="10")).when(n % 5 == 2, held(method="stealth", slow_drip="true")).when(n % 5 == 3, held(patient_on_block=F.when(n % 2 == 0, "true").otherwise("false"))).when(n % 5 == 4, held(allow_stealth="false"))
    recon = F.when(n % 7 == 1, held(waf="cloudflare", js_required="true")).when(n % 7 == 2, held(js_required="true", waf="")).when(n % 7 == 3, held(js_required="true", challenge_detected="false"))
    over = F.when(n % 11 == 0, held(initial_strategy="visible", access_max_attempts=F.when(n % 13 == 0, "5"))).when(n % 11 == 1, held(access_escalation_mode="static", access_max_attempts=F.when(n % 13 == 0, "5"))).otherwise(held(access_max_attempts=F.when(n % 13 == 0, "5")))
    return read(spark, sf_dir, "events").select("event_id", policy.access_plan(playbook, spec, recon, over).alias("p")).select("event_id", "p.*")


@R.add("log_stats", "select event_type, count(*) as runs, sum(value) as total, cast(min(ts) as date) as first_day, cast(max(ts) as date) as last_day, count(*) filter (where value < 20) as failures from events group by event_type")
def log_stats(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.sum("value").alias("total"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), F.count_if(F.col("value") < 20).alias("failures"))


@R.add("manifest", f"select host, url_key, count(*) as captures, min(page_id) as first_page, array_to_string(list_sort(list(page_id)), ',') as found_on, sum(len(html)) // 1024 as kb from (select *, {HOST} as host, path as url_key from {P}) group by host, url_key")
def manifest(spark, sf_dir):
    """Assets once each by address: the first wins, the pages it was found on are gathered."""
    u = F.col("url")
    p = read(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("url_key"), F.length("html").alias("size"))
    return p.groupBy("host", "url_key").agg(F.count(F.lit(1)).alias("captures"), F.min("page_id").alias("first_page"), F.array_join(F.sort_array(F.collect_list("page_id")), ",").alias("found_on"), F.floor(F.sum("size") / 1024).alias("kb"))


