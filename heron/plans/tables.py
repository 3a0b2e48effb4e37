"""Readers and rules over whole tables: settings files, cookies, logs and targets written from their rows, names and labels as they occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.exprs import Registry, quoted
from heron.functions import text as T
from heron.functions import urls
from heron.plans import links
from heron.plans.access import NOW, read
from heron.plans.urls import sql_label
from heron.session import folder
from heron.sources import readers

R = Registry()

#: Sections expected of a site and the words that stand for them, in the pages' own languages.
SECTIONS = {"articles": ["the", "der", "die", "que"], "joining": ["and", "und", "et"], "places": ["in", "dans", "para"], "zebra": ["zebra"]}
WANTED = ["the", "of us", "articles", "joining", "zebra"]


def _sql_section(label: str) -> str:
    near = " ".join(f"when {' or '.join(f'contains({label}, {quoted(n)}) or contains({quoted(n)}, {label})' for n in names)} then {quoted(s)}" for s, names in SECTIONS.items())
    return f"case when {label} in ({', '.join(map(quoted, SECTIONS))}) then {label} {near} end"


@R.add("nav_tiers", f"""with t as (select distinct host, text, {sql_label('text')} as n from {links.ANCHORS} where text <> ''), m as (select host, text, n, {_sql_section('n')} as section, unnest([{', '.join(map(quoted, WANTED))}]) as expected from t),
 d as (select host, text, expected, case when contains(lower(text), expected) then 1 when contains(n, {sql_label('expected')}) or contains({sql_label('expected')}, n) then 2 when section = expected or section = {sql_label('expected')} then 3 end as tier from m),
 b as (select host, expected, min(struct_pack(tier := tier, label := text)) as b from d where tier is not null group by all)
 select host, expected, b.label as label, case b.tier when 1 then 'direct' when 2 then 'normalized' else 'synonym' end as method, round_even(count(*) over (partition by host) / {len(WANTED)}.0::double, 2) as coverage from b""")
def nav_tiers(spark, sf_dir):
    """Expected sections among each site's labels in three tiers: directly, normalised, by synonym; the first label in order of name, and the share found."""
    x, n = F.col("expected"), F.col("n")
    labels = links.links(spark, sf_dir).filter("text <> ''").select("host", "text").distinct().select("host", "text", urls.nav_label(F.col("text")).alias("n"), urls.nav_section(F.col("text"), SECTIONS).alias("section"))
    each = labels.withColumn("expected", F.explode(F.array(*map(F.lit, WANTED)))).withColumn("e", urls.nav_label(x))
    tier = F.when(F.contains(F.lower("text"), x), 1).when(F.contains(n, F.col("e")) | F.contains(F.col("e"), n), 2).when((F.col("section") == x) | (F.col("section") == F.col("e")), 3)
    best = each.withColumn("tier", tier).filter("tier is not null").groupBy("host", "expected").agg(F.min(F.struct("tier", F.col("text").alias("label"))).alias("b"))
    share = best.groupBy("host").agg(F.bround(F.count(F.lit(1)) / len(WANTED), 2).alias("coverage"))
    return best.join(share, "host").select("host", "expected", "b.label", F.element_at(F.array(*map(F.lit, ("direct", "normalized", "synonym"))), F.col("b.tier")).alias("method"), "coverage")


@R.add("nav_label_sections", f"select text as label, n as normalized, {_sql_section('n')} as section, count(*) as links from (select text, {sql_label('text')} as n from {links.ANCHORS} where text <> '') group by all")
def nav_label_sections(spark, sf_dir):
    """Every label of the pages' links, normalised, with the section it stands for."""
    t = F.col("text")
    return links.links(spark, sf_dir).filter("text <> ''").groupBy(t.alias("label")).agg(F.count(F.lit(1)).alias("links")).select("label", urls.nav_label(F.col("label")).alias("normalized"), urls.nav_section(F.col("label"), SECTIONS).alias("section"), "links")


_COOKIES = "(select user_id, event_type as name, case when event_id % 7 = 0 then null when event_id % 11 = 0 then -1 else epoch_us(ts) // 1000000 + cast(floor(value * 86400) as bigint) end as expires from events)"
_AT = f"(epoch_us(timestamp '{NOW}') // 1000000)"


def cookies(spark, sf_dir):
    """user_id, name, expires (seconds): a cookie for each event, some of the session."""
    n = F.col("event_id")
    expires = F.when(n % 7 == 0, None).when(n % 11 == 0, F.lit(-1)).otherwise(F.unix_seconds("ts") + F.floor(F.col("value") * 86400))
    return read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), expires.cast("long").alias("expires"))


@R.add("cookie_jars", f"""select user_id, count(*) as cookies, count(*) filter (where expires is null or expires <= 0 or expires >= {_AT}) as valid, min(expires) filter (where expires > 0) as earliest, count(*) filter (where expires > 0 and expires >= {_AT} and expires - {_AT} <= 604800) as expiring,
 case when min(expires) filter (where expires > 0) is null then 'session' when min(expires) filter (where expires > 0) < {_AT} then 'EXPIRED' when min(expires) filter (where expires > 0) - {_AT} <= 604800 then 'expiring' else 'ok' end as status from {_COOKIES} group by user_id""")
def cookie_jars(spark, sf_dir):
    """Each domain's cookies: how many are valid, the earliest expiry, what runs out within a week."""
    now, e = F.unix_seconds(F.lit(NOW).cast("timestamp")), F.col("expires")
    first = F.min(F.when(e > 0, e))
    by = cookies(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("cookies"), F.count_if(e.isNull() | (e <= 0) | (e >= now)).alias("valid"), first.alias("earliest"), F.count_if((e > 0) & (e >= now) & (e - now <= 604800)).alias("expiring"))
    return by.withColumn("status", F.when(F.col("earliest").isNull(), "session").when(F.col("earliest") < now, "EXPIRED").when(F.col("earliest") - now <= 604800, "expiring").otherwise("ok"))


@R.add("work_summary", f"""with q as (select user_id, case when user_id % 3 = 0 then 'high' else 'normal' end as priority, min(ts) as added from events where value < 20 group by user_id), j as (select user_id, min(expires) filter (where expires > 0) as earliest from {_COOKIES} group by user_id)
 select 'queue:' || priority as what, count(*) as n, min(added) as since from q group by all union all select 'cookies:' || case when earliest is null then 'session' when earliest < {_AT} then 'EXPIRED' else 'ok' end, count(*), null from j group by all""")
def work_summary(spark, sf_dir):
    """One table of what waits: queue entries by priority with the oldest, cookie jars by status."""
    now = F.unix_seconds(F.lit(NOW).cast("timestamp"))
    queued = read(spark, sf_dir, "events").filter("value < 20").groupBy("user_id").agg(F.min("ts").cast("timestamp_ntz").alias("added")).withColumn("what", F.when(F.col("user_id") % 3 == 0, "queue:high").otherwise("queue:normal"))
    jars = cookies(spark, sf_dir).groupBy("user_id").agg(F.min(F.when(F.col("expires") > 0, F.col("expires"))).alias("e")).withColumn("what", F.when(F.col("e").isNull(), "cookies:session").when(F.col("e") < now, "cookies:EXPIRED").otherwise("cookies:ok"))
    none = F.lit(None).cast("timestamp_ntz")
    return queued.groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.min("added").alias("since")).unionByName(jars.groupBy("what").agg(F.count(F.lit(1)).alias("n"), none.alias("since")))


_DOMAIN = "case c_custkey % 5 when 0 then 'c' || c_custkey || '.com' when 1 then 'www.c' || c_custkey || '.com' when 2 then 'shop.c' || c_custkey || '.co.uk' when 3 then 'c' || c_custkey || '.com/en' else 'intranet' || c_custkey end"


def customers(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.expr(_DOMAIN).alias("domain"), F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3 + 1).cast("int").alias("tier"))


@R.add("seed_starts", f"""select name, domain, tier, case when len(split_part(domain, '/', 1)) - len(replace(split_part(domain, '/', 1), '.', '')) <= 1 and not starts_with(domain, 'www.') then 'https://www.' || domain else 'https://' || domain end as start_url, replace(domain, 'www.', '') as cache_key
 from (select c_name as name, {_DOMAIN} as domain, cast(c_nationkey % 3 + 1 as integer) as tier from customer)""")
def seed_starts(spark, sf_dir):
    """Seed files written from customers and read back: where each crawl begins and what its probe is cached by."""
    path = folder(spark)
    rows = customers(spark, sf_dir).select(F.struct("name", "domain", F.array("segment").alias("category"), "tier").alias("c"), F.pmod(F.xxhash64("name"), F.lit(4)).alias("file"))
    rows.groupBy("file").agg(F.to_json(F.struct(F.collect_list("c").alias("carriers"))).alias("value")).select("value").repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.seeds(spark, path).select("name", "domain", "tier", urls.start_url(F.col("domain")).alias("start_url"), urls.cache_key(F.col("domain")).alias("cache_key"))


@R.add("company_categories", "select category, cast(c_nationkey % 3 + 1 as integer) as tier, count(*) as companies from (select *, unnest(case when c_custkey % 2 = 0 then [lower(c_mktsegment)] else [lower(c_mktsegment), 'odd'] end) as category from customer) group by all")
def company_categories(spark, sf_dir):
    """Company lists written from customers, bare and under `carriers`, categories as one name or a list, read back."""
    path = folder(spark)
    c = read(spark, sf_dir, "customer")
    name = F.lower("c_mktsegment")
    category = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(name.alias("category")))).otherwise(F.to_json(F.struct(F.array(name, F.lit("odd")).alias("category"))))
    item = F.concat(F.regexp_replace(category, r"\}$", ""), F.lit(', "name": "'), "c_name", F.lit('", "tier": '), (F.col("c_nationkey") % 3 + 1).cast("string"), F.lit("}"))
    lists = c.select(item.alias("item"), F.pmod(F.xxhash64("c_name"), F.lit(4)).alias("file")).groupBy("file").agg(F.array_join(F.collect_list("item"), ", ").alias("items"))
    lists.select(F.when(F.col("file") % 2 == 0, F.concat(F.lit("["), "items", F.lit("]"))).otherwise(F.concat(F.lit('{"carriers": ['), "items", F.lit("]}"))).alias("value")).repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.companies(spark, path).select(F.explode("category").alias("category"), "tier").groupBy("category", "tier").agg(F.count(F.lit(1)).alias("companies"))


#: Flags of a strategy: browser, headed.
FLAGS = {"requests": (False, False), "js": (True, False), "stealth": (True, False), "visible": (True, True)}
_BOOKS = "(select distinct regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') as domain from pages)"
_STRATEGY = "case length(domain) % 4 when 0 then 'requests' when 1 then 'js' when 2 then 'stealth' else 'visible' end"


@R.add("playbook_of_sites", f"""with b as (select domain, {_STRATEGY} as max_strategy from {_BOOKS} where length(domain) % 5 <> 0), s as (select distinct regexp_extract(url, '^https?://([^/?#]+)', 1) as domain from pages)
 select s.domain, coalesce(x.max_strategy, y.max_strategy) as max_strategy, coalesce(x.max_strategy, y.max_strategy) <> 'requests' as browser, coalesce(x.max_strategy, y.max_strategy) = 'visible' as headed from s left join b x on x.domain = s.domain left join b y on y.domain = regexp_replace(s.domain, '^www\\.', '')""")
def playbook_of_sites(spark, sf_dir):
    """Playbook files written from the pages' sites and read back: each site's own, else that of its name without www., and the flags of its strategy."""
    path = folder(spark)
    site = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    sites = read(spark, sf_dir, "pages").select(site.alias("domain")).distinct()
    books = sites.select(F.regexp_replace("domain", r"^www\.", "").alias("domain")).distinct()
    entry = F.when(F.length("domain") % 5 == 0, F.concat(F.lit('"'), "domain", F.lit('": "not a mapping"'))).otherwise(F.concat(F.lit('"'), "domain", F.lit('": {"max_strategy": "'), F.expr(_STRATEGY), F.lit('", "delay": 2}')))
    files = books.select(entry.alias("entry"), F.pmod(F.xxhash64("domain"), F.lit(4)).alias("file")).groupBy("file").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ", "), F.lit("}")).alias("value"))
    files.select("value").repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    held = readers.playbooks(spark, path).select("domain", "max_strategy")
    exact = sites.join(held.withColumnRenamed("max_strategy", "x"), "domain", "left").withColumn("bare", F.regexp_replace("domain", r"^www\.", ""))
    named = exact.join(held.select(F.col("domain").alias("bare"), F.col("max_strategy").alias("y")), "bare", "left").select("domain", F.coalesce("x", "y").alias("max_strategy"))
    flag = lambda k: F.try_element_at(F.create_map(*(F.lit(v) for s, f in FLAGS.items() for v in (s, f[k]))), F.col("max_strategy"))
    return named.withColumns({"browser": flag(0), "headed": flag(1)})


NAMES = {"view": "requests", "click": "js", "purchase": "stealth", "signup": "visible"}


@R.add("strategy_names_used", "select user_id, count(*) as attempts, " + ", ".join(f"count(*) filter (where event_type = {quoted(k)}) as {v}" for k, v in NAMES.items()) + ", count(*) filter (where event_type = 'error') as unknown from events group by user_id")
def strategy_names_used(spark, sf_dir):
    """Attempts of each domain by the strategy that the name they carry stands for, however it is written."""
    raw = F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.initcap("event_type")), F.lit(" "))
    named = read(spark, sf_dir, "events").select("user_id", urls.mapped(raw, NAMES, "unknown").alias("s"))
    return named.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), *(F.count_if(F.col("s") == s).alias(s) for s in [*NAMES.values(), "unknown"]))


@R.add("freshen_due", f"""select user_id, spec, seconds, epoch_us(timestamp '{NOW}') // 1000000 - epoch_us(last) // 1000000 >= seconds as due from (select user_id, max(ts) as last, (count(*) % 9 + 1) || case user_id % 3 when 0 then 'd' when 1 then 'h' else 'm' end as spec, (count(*) % 9 + 1) * case user_id % 3 when 0 then 86400 when 1 then 3600 else 60 end as seconds from events group by user_id)""")
def freshen_due(spark, sf_dir):
    """Which domains are older than the interval they are to be kept fresh by, as written: 7d, 24h, 30m."""
    unit = F.element_at(F.array(*map(F.lit, "dhm")), (F.col("user_id") % 3 + 1).cast("int"))
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), (F.count(F.lit(1)) % 9 + 1).alias("n"))
    held = by.select("user_id", "last", F.concat(F.col("n").cast("string"), unit).alias("spec")).withColumn("seconds", T.freshen_seconds(F.col("spec")))
    return held.select("user_id", "spec", "seconds", (F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds("last") >= F.col("seconds")).alias("due"))


@R.add("run_logs", "select cast(ts as date) as day, count(*) as runs, sum(user_id)::bigint as pages, round_even(max(value), 6) as longest from events where event_id % 50 <> 0 group by 1")
def run_logs(spark, sf_dir):
    """Run logs written as JSON lines, one in fifty of them broken, and summed up by day."""
    path = folder(spark)
    line = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), F.col("user_id").alias("pages"), F.col("value").alias("duration_sec")))
    read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return readers.logs(spark, path).groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum("pages").alias("pages"), F.bround(F.max("duration_sec"), 6).alias("longest"))


@R.add("post_targets", "select 'u' || user_id as account, count(*) as posts, min(event_id) as first_idx, cast(max(event_id) as varchar) as last_post from events where event_type in ('view', 'click') group by user_id")
def post_targets(spark, sf_dir):
    """Targets written as tab-separated rows with other addresses among them, read back and counted by account."""
    path = folder(spark)
    post = F.col("event_type").isin("view", "click")
    address = F.when(post, F.concat(F.lit("https://x.com/u"), F.col("user_id").cast("string"), F.lit("/status/"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("https://x.com/u"), F.col("user_id").cast("string")))
    read(spark, sf_dir, "events").select(F.col("event_id").cast("int").alias("idx"), F.col("ts").cast("string").alias("timestamp"), address.alias("url")).write.option("sep", "\t").option("header", True).csv(path)
    found = readers.targets(spark, path)
    return found.groupBy(F.col("user").alias("account")).agg(F.count(F.lit(1)).alias("posts"), F.min("idx").cast("long").alias("first_idx"), F.max(F.col("post").cast("long")).cast("string").alias("last_post"))
