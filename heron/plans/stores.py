"""Two stores compared: each crawl with the snapshot before it, from stored files."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.exprs import Registry
from heron.functions.asof import asof_join
from heron.plans.access import read
from heron.session import folder

R = Registry()
DAY = 86_400_000_000
SNAPSHOTS = "user_id long, snap_at long, words double, strategy string, blocked boolean"
CRAWLS = "user_id long, event_id long, crawled_at long, found double, method string"


def stores(spark, sf_dir):
    """Snapshots and crawls, written to a folder each and read back."""
    e, path = read(spark, sf_dir, "events"), folder(spark)
    views = e.filter("event_type in ('view', 'click')").groupBy("user_id", F.to_date("ts").alias("day"))
    views.agg(F.max(F.unix_micros("ts")).alias("snap_at"), F.bround(F.avg("value"), 6).alias("words"), F.max("event_type").alias("strategy"), (F.max("value") < 20).alias("blocked")).drop("day").write.parquet(f"{path}/snapshots")
    e.filter("event_type = 'purchase'").select("user_id", "event_id", F.unix_micros("ts").alias("crawled_at"), F.col("value").alias("found"), F.when(F.col("event_id") % 2 == 0, "view").otherwise("click").alias("method")).write.parquet(f"{path}/crawls")
    return spark.read.schema(SNAPSHOTS).parquet(f"{path}/snapshots"), spark.read.schema(CRAWLS).parquet(f"{path}/crawls")


_STORES = """s as (select user_id, max(epoch_us(ts)) as snap_at, round_even(avg(value), 6) as words, max(event_type) as strategy, max(value) < 20 as blocked from events where event_type in ('view', 'click') group by user_id, cast(ts as date)),
 c as (select user_id, event_id, epoch_us(ts) as crawled_at, value as found, case when event_id % 2 = 0 then 'view' else 'click' end as method from events where event_type = 'purchase'),
 j as (select c.*, s.snap_at, s.words, s.strategy, s.blocked from c asof left join s on c.user_id = s.user_id and c.crawled_at > s.snap_at),
 k as (select user_id, event_id, found, method, case when crawled_at - snap_at <= 259200000000 then snap_at end as snap_at, case when crawled_at - snap_at <= 259200000000 then words end as words, case when crawled_at - snap_at <= 259200000000 then strategy end as strategy, case when crawled_at - snap_at <= 259200000000 then blocked end as blocked from j)"""


@R.add("drift_as_of", f"""with {_STORES} select user_id, event_id, snap_at, case when words > 0 then round_even((found - words) / words, 4) end as change, array_to_string(list_filter([case when words > 0 then case when (found - words) / words < -0.5 then 'content_drop:high' when (found - words) / words < -0.3 then 'content_drop:medium' when (found - words) / words > 0.3 then 'content_increase:low' end end,
 case when strategy <> method then case when words > 0 and (found - words) / words < -0.3 then 'access_degradation:high' else 'strategy_change:low' end end, case when not blocked and found < 10 then 'new_block:high' when blocked and found >= 10 then 'block_resolved:low' end], lambda x: x is not null), ',') as alerts from k""")
def drift_as_of(spark, sf_dir):
    """Each crawl against the last snapshot strictly before it, if that is at most three days old; what changed."""
    snapshots, crawls = stores(spark, sf_dir)
    both = asof_join(crawls, snapshots, ["user_id"], "crawled_at", "snap_at", ["words", "strategy", "blocked"], DAY, strict=True, within=3 * DAY)
    c, moved = F.when(F.col("words") > 0, (F.col("found") - F.col("words")) / F.col("words")), F.col("strategy") != F.col("method")
    alerts = F.array(
        F.when(c < -0.5, "content_drop:high").when(c < -0.3, "content_drop:medium").when(c > 0.3, "content_increase:low"),
        F.when(moved & (F.coalesce(c, F.lit(0.0)) < -0.3), "access_degradation:high").when(moved, "strategy_change:low"),
        F.when(~F.col("blocked") & (F.col("found") < 10), "new_block:high").when(F.col("blocked") & (F.col("found") >= 10), "block_resolved:low"),
    )
    return both.select("user_id", "event_id", "snap_at", F.bround(c, 4).alias("change"), F.array_join(F.filter(alerts, lambda a: a.isNotNull()), ",").alias("alerts"))
