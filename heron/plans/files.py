"""Source, sink and stream queries: each writes what it needs to a folder of its own and reads it back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from heron.exprs import Registry, sql_first_match
from heron.functions import urls
from heron.plans.access import read
from heron.plans.corpus import SITES, site_pages
from heron.plans.urls import P, pages
from heron.session import folder as _folder
from heron.sources import readers, sinks
from heron.streaming import telemetry

R = Registry()


@R.add("source_site_documents", f"select host as domain, count(*) as pages, cast(sum(len(regexp_extract_all(text, '\\S+'))) as bigint) as words from {SITES} group by host")
def source_site_documents(spark, sf_dir):
    """Nested site documents written by domain, read back with an explicit schema and opened into pages."""
    rows = site_pages(spark, sf_dir).select("page_id", "host", F.struct("url", F.col("page_type"), F.col("text").alias("full_text"), F.regexp_count("text", F.lit(r"\S+")).alias("word_count")).alias("p"))
    path = _folder(spark)
    sinks.write_sites(rows.groupBy(F.col("host").alias("domain")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "p"))), lambda s: s["p"]).alias("pages")), path)
    pages = readers.pages_of(readers.sites(spark, path).drop("base_domain"))
    return pages.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.sum("word_count").alias("words"))


@R.add("source_csv_export", f"select page_type, count(*) as pages, min(page_id) as first_page from {SITES} group by page_type")
def source_csv_export(spark, sf_dir):
    path = _folder(spark)
    sinks.export_csv(site_pages(spark, sf_dir).select("page_id", "host", "page_type"), path)
    back = spark.read.schema("page_id long, host string, page_type string").option("header", True).csv(path)
    return back.groupBy("page_type").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@R.add("source_logs", "select 2 as runs, 11 as pages, 1.5::double as longest")
def source_logs(spark, sf_dir):
    """JSON lines with a malformed one."""
    path = _folder(spark)
    lines = ['{"timestamp": "2024-01-01T00:00:00", "pages": 5, "duration_sec": 1.5}', "{broken", '{"timestamp": "2024-01-02T00:00:00", "pages": 6, "duration_sec": 0.5}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return readers.logs(spark, path).agg(F.count("timestamp").cast("int").alias("runs"), F.sum("pages").cast("int").alias("pages"), F.max("duration_sec").alias("longest"))


@R.add("source_targets", "select * from (values (1, 'ann', '11'), (4, 'bob', '22')) as t(idx, account, post)")
def source_targets(spark, sf_dir):
    path = _folder(spark)
    rows = ["idx\ttimestamp\turl", "1\tt\thttps://x.com/ann/status/11", "2\tt\thttps://x.com/ann", "3", "4\tt\thttps://x.com/bob/status/22"]
    spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.text(path)
    found = readers.targets(spark, path, 10)
    return readers.look(found, ["idx", "user", "post"], search="STATUS", tail=5).withColumnRenamed("user", "account")


@R.add("source_jsonl_export", f"select page_type, count(*) as pages, cast(sum(len(regexp_extract_all(text, '\\S+'))) as bigint) as words from {SITES} group by page_type")
def source_jsonl_export(spark, sf_dir):
    """Pages as JSON lines, read back."""
    path = _folder(spark)
    sinks.export_jsonl(site_pages(spark, sf_dir).select("page_id", "host", "page_type", "text"), path)
    back = spark.read.schema("page_id long, page_type string, text string").json(path)
    return back.groupBy("page_type").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.regexp_count("text", F.lit(r"\S+"))).cast("long").alias("words"))


@R.add("source_run_log", "select event_type as domain, 2 as runs, 2 * count(*) as pages from events group by event_type")
def source_run_log(spark, sf_dir):
    """Run records appended twice to one log, read back as a log."""
    path = _folder(spark)
    runs = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("pages")).select(F.lit("2024-01-01T00:00:00").alias("timestamp"), F.array("event_type").alias("domains"), "pages")
    for _ in range(2):
        sinks.append_log(runs, path)
    return readers.logs(spark, path).groupBy(F.col("domains")[0].alias("domain")).agg(F.count(F.lit(1)).cast("int").alias("runs"), F.sum("pages").alias("pages"))


@R.add("source_site_of", f"with s as (select host, count(*) as pages from {SITES} group by host) select host as domain, pages from s union all select host || '.extra', (select arg_min(b.pages, replace(b.host, '.', '_') || '.json') from s b where starts_with(replace(b.host, '.', '_'), split_part(s.host, '.', 1))) from s union all select 'nowhere.example', null")
def source_site_of(spark, sf_dir):
    """Seeds with their site documents: by file name, else by the first label; some have none."""
    sites = site_pages(spark, sf_dir).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = sites.select(F.concat(F.replace("host", F.lit("."), F.lit("_")), F.lit(".json")).alias("file"), "pages")
    seeds = sites.select(F.col("host").alias("domain")).unionByName(sites.select(F.concat("host", F.lit(".extra")).alias("domain"))).unionByName(spark.range(1).select(F.lit("nowhere.example").alias("domain")))
    return readers.site_of(found, seeds).select("domain", "site.pages")


PROFILE = {"name": "planted", "priority": {"high": ["/en/"], "medium": ["/fr/", "/de/"], "low": ["[0-9]$", "(broken"]}, "products": [{"name": "first", "patterns": ["/en/[a-f]"], "terms": ["the", "of"]}, "odd"], "settings": {"max_pages": 7}}


@R.add("source_profile", f"select page_id, {sql_first_match('lower(path)', {'high': ['/en/'], 'medium': ['/fr/', '/de/'], 'low': ['[0-9]$', chr(92) + '(broken']}, 'normal')} as level, 7 as max_pages, 'planted' as profile from {P}")
def source_profile(spark, sf_dir):
    """A profile written as settings, found by name and used as a rule pack; a broken pattern is taken as text."""
    path = _folder(spark)
    spark.createDataFrame([(json.dumps(PROFILE),)], "value string").coalesce(1).write.text(path)
    held = readers.profile_of(json.loads(readers._text(spark, path)))
    p = urls.path(F.col("url"))
    return pages(spark, sf_dir).select("page_id", urls.priority(p, held.priorities).alias("level"), F.lit(held.max_pages).alias("max_pages"), F.lit(held.name).alias("profile"))


@R.add("stream_counters", "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as attempts, count(*) filter (where value >= 30) as successes from events group by all")
def stream_counters(spark, sf_dir):
    """Daily counters from a stream that has run to its end."""
    table = telemetry.drain(telemetry.counters(telemetry.events(spark, sf_dir)), _folder(spark), "complete")
    return table.withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add("stream_failures", "select user_id, coalesce(min(n) filter (where value >= 30) - 1, count(*)) as failures, coalesce(min(n) filter (where value >= 30) - 1, count(*)) >= 2 as requeue from (select *, row_number() over (partition by user_id order by ts desc) as n from events) group by user_id")
def stream_failures(spark, sf_dir):
    out = telemetry.failure_runs(telemetry.events(spark, sf_dir).select("user_id", "value", "ts"))
    return telemetry.drain(out, _folder(spark), "update", ["user_id"])


@R.add("stream_first_seen", "select count(distinct user_id) as domains from events")
def stream_first_seen(spark, sf_dir):
    """How many rows are left when each domain passes once."""
    out = telemetry.first_seen(telemetry.events(spark, sf_dir), "60 days")
    return telemetry.drain(out, _folder(spark)).agg(F.count("user_id").alias("domains"))


@R.add("stream_completions", "select date_trunc('day', ts)::timestamp + to_days(d) as \"end\", user_id, count(*) as done from events, (select unnest([1, 2, 3]) as d) group by all having count(*) >= 3")
def stream_completions(spark, sf_dir):
    """Domains with three completions within three days, for every day."""
    table = telemetry.drain(telemetry.completions(telemetry.events(spark, sf_dir), "3 days", "1 day"), _folder(spark), "complete")
    return table.withColumn("end", F.col("end").cast("timestamp_ntz"))


@R.add("stream_queue", "select user_id, count(*) as attempts, array_to_string(list_sort(list_distinct(list(event_type))), ',') as tried, min(ts) as added from events where value < 20 group by user_id")
def stream_queue(spark, sf_dir):
    """The queue of failed domains, kept up as attempts come."""
    table = telemetry.drain(telemetry.queue(telemetry.events(spark, sf_dir)), _folder(spark), "update", ["user_id"])
    return table.withColumn("added", F.col("added").cast("timestamp_ntz"))


@R.add("stream_strategies", "select user_id, arg_max(event_type, (ts, event_id)) as method, max(ts) as updated_at from events where value >= 30 group by user_id")
def stream_strategies(spark, sf_dir):
    """The cache of strategies that worked, kept up as attempts come."""
    table = telemetry.drain(telemetry.strategies(telemetry.events(spark, sf_dir)), _folder(spark), "update", ["user_id"])
    return table.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@R.add("stream_drift", "select user_id, day, round_even(words, 6) as words, round_even(lag(words) over (partition by user_id order by day), 6) as was from (select user_id, cast(ts as date) as day, sum(value) as words from events group by 1, 2)")
def stream_drift(spark, sf_dir):
    """Daily snapshots of each domain beside the one before, kept up as attempts come."""
    rows = telemetry.events(spark, sf_dir).select("user_id", "value", "ts")
    table = telemetry.drain(telemetry.snapshot_changes(rows), _folder(spark), "update", ["user_id", "day"])
    return table.select("user_id", "day", F.bround("words", 6).alias("words"), F.bround("was", 6).alias("was"))
