"""Sites as stored tables, what is on their pages, and which visits can be skipped."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.exprs import Registry, quoted, sql_match
from heron import rules
from heron.functions import containers, features, hints, html, probe
from heron.functions import urls as U
from heron.plans import links, robots
from heron.plans.access import read
from heron.session import folder
from heron.sources.store import SiteStore
from heron.streaming import telemetry

R = Registry()
KIND = "case when regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(png|jpe?g|gif|svg|webp)$') then 'image' when regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(pdf|docx?|xlsx?|pptx?)$') then 'document' when regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(mp4|webm|mov)$') then 'video' else 'page' end"


def kind(url):
    bare = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    return F.when(bare.rlike(r"\.(png|jpe?g|gif|svg|webp)$"), "image").when(bare.rlike(r"\.(pdf|docx?|xlsx?|pptx?)$"), "document").when(bare.rlike(r"\.(mp4|webm|mov)$"), "video").otherwise("page")


@R.add("asset_manifest", f"select url, {KIND} as kind, count(distinct page_id) as pages, min(page_id) as first_page from {links.LINKS} group by url")
def asset_manifest(spark, sf_dir):
    """Every linked address once, with its kind, the number of pages it is on and the first of them; pages are held as bits."""
    held = containers.containers(links.links(spark, sf_dir).select("url", "page_id"), ["url"], "page_id")
    return held.groupBy("url").agg(F.sum("n").alias("pages"), F.min("first").alias("first_page")).select("url", kind(F.col("url")).alias("kind"), "pages", "first_page")


@R.add("asset_pages", f"select distinct url, page_id as page from {links.LINKS}")
def asset_pages(spark, sf_dir):
    """The pages that each address is on, opened from their containers."""
    held = containers.containers(links.links(spark, sf_dir).select("url", "page_id"), ["url"], "page_id")
    return containers.pages_of(held, ["url"])


#: What to look for, in the words of the pages.
WORDS = {"articles": (["/the$", "/der$"], ["^die$"], "high", 1), "joining": (["/an"], ["^und$", "^et$"], "medium", 2), "rest": (["zebra"], ["que", "thth"], "low", 1)}


def _sql_hints() -> str:
    out = []
    for k, (us, ts, _, _) in enumerate(WORDS.values()):
        cases = [f"when regexp_matches(lower(url), {quoted(p)}) then {quoted(f"URL pattern '{p}' matched: ")} || url" for p in us] + [f"when regexp_matches(lower(text), {quoted(p)}) then {quoted(f"Link text matched '{p}': ")} || text" for p in ts]
        out.append(f"select page_id, sub, pos, {k} as rank, case {' '.join(cases)} end as reason from l")
    return " union all ".join(out)


_PAGE_TEXT = " union all ".join(f"select page_id, {k} as rank, case {' '.join(f'when regexp_matches(lower(text), {quoted(p)}) then {quoted(chr(80) + f"age text contains {chr(39)}{p}{chr(39)}")}' for p in ts)} end as reason from x" for k, (_, ts, _, _) in enumerate(WORDS.values()))


@R.add("page_hints", f"""with l as (select page_id, url, text, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as sub, row_number() over () as pos from {links.LINKS}), x as (select page_id, {html.SQL_VISIBLE} as text from pages),
 b as (select page_id, sub, min(struct_pack(rank := rank, pos := pos, reason := reason)) as b from ({_sql_hints()}) where reason is not null and sub <> '' group by all),
 a as (select page_id, sub as subtree, b.rank as rank, b.reason as reason from b union all select page_id, '', rank, reason from ({_PAGE_TEXT}) t where reason is not null and (page_id, rank) not in (select (page_id, b.rank) from b))
 select page_id, [{', '.join(map(quoted, WORDS))}][rank + 1] as feature, subtree, [{', '.join(quoted(p) for _, _, p, _ in WORDS.values())}][rank + 1] as priority, cast(case when subtree = '' then 0 else [{', '.join(str(b) for *_, b in WORDS.values())}][rank + 1] end as int) as depth_boost, reason from a""")
def page_hints(spark, sf_dir):
    """Subtrees of every page that a crawl should look into, and why; features that only the text speaks of have none."""
    found = links.links(spark, sf_dir).withColumn("path", U.path(F.col("url")))
    texts = read(spark, sf_dir, "pages").select("page_id", html.visible(F.col("html")).alias("text"))
    return hints.hints(found, texts, WORDS)


_ROOT = "replace(regexp_extract(url, '^https?://([^/?#]+)', 1), 'www.', '')"
_SIGNS = ", ".join(f"{sql_match('lower(html)', marks, '(?s)')} as {sign}" for sign, marks in rules.PAGE_SIGNS.items())


@R.add("page_probe", f"""with z as (select page_id, {_ROOT} as site, html, url, case when regexp_matches(html, '(?is)<(nav|header)\\b') then array_to_string(regexp_extract_all(html, '(?is)<nav\\b.*?</nav\\s*>|<header\\b.*?</header\\s*>'), '') else html end as bars from pages),
 l as (select page_id, site, regexp_replace(regexp_replace(h, '[?#].*$', ''), '/+$', '') as path, h, k from (select page_id, site, unnest(regexp_extract_all(bars, '(?is)<a\\b[^>]*\\bhref="([^"]*)"[^>]*>.*?</a>', 1)) as h, generate_subscripts(regexp_extract_all(bars, '(?is)<a\\b[^>]*\\bhref="([^"]*)"[^>]*>.*?</a>', 1), 1) as k from z)),
 n as (select page_id, string_agg(path, ' ' order by k) as nav, max(len(path) - len(replace(path, '/', ''))) as depth from (select page_id, path, min(k) as k from l group by all) group by page_id)
 select page_id, coalesce(nav, '') as nav, cast(coalesce(depth, 0) as int) as nav_depth, cast(len(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref="[^"]*"[^>]*>.*?</a>')) as int) as links, {_SIGNS}, case when regexp_matches(html, '(?i)<main\\b') then 'main' when regexp_matches(html, '(?i)<article\\b') then 'article' end as main_selector from z left join n using (page_id)""")
def page_probe(spark, sf_dir):
    """What every page as it stands says of its site: contents of its bars, links, signs and where its text is."""
    r = probe.probes(read(spark, sf_dir, "pages"))
    return r.select("page_id", F.array_join(F.transform("nav", lambda x: x["url"]), " ").alias("nav"), "nav_depth", "links", *rules.PAGE_SIGNS, "main_selector")


_SITE = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


def site_store(spark, sf_dir) -> SiteStore:
    """Pages, seeds and attempts by domain: an attempt is of the page whose number is its user's."""
    store = SiteStore(spark)
    pages = store.write("pages", read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("domain"), "page_id", F.length("html").alias("size")))
    store.write("seeds", pages.select("domain").distinct().withColumn("tier", F.length("domain") % 3 + 1))
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), "event_type", "value")
    store.write("attempts", events.join(pages.select("page_id", "domain"), "page_id").select("domain", "event_type", "value"))
    return store


@R.add("site_store_summary", f"""with p as (select {_SITE} as domain, page_id, length(html) as size from pages), a as (select domain, value from events join p on user_id = page_id)
 select domain, tier, pages, size, coalesce(attempts, 0) as attempts, coalesce(good, 0) as good from (select domain, length(domain) % 3 + 1 as tier, count(*) as pages, cast(sum(size) as bigint) as size from p group by domain) left join (select domain, count(*) as attempts, count(*) filter (where value >= 30) as good from a group by domain) using (domain)""")
def site_store_summary(spark, sf_dir):
    """Seeds with their pages and attempts, from bucketed tables that are joined without an exchange."""
    store = site_store(spark, sf_dir)
    pages = store.table("pages").groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size"))
    tried = store.table("attempts").groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("value") >= 30).alias("good"))
    none = F.lit(0).cast("long")
    return store.table("seeds").hint("merge").join(pages.hint("merge"), "domain").join(tried.hint("merge"), "domain", "left").select("domain", "tier", "pages", "size", F.coalesce("attempts", none).alias("attempts"), F.coalesce("good", none).alias("good"))


@R.add("stream_freshness", """with d as (select user_id, event_id, ts from events where event_type = 'signup'), c as (select user_id, ts as crawled_at from events where event_type = 'view' and value >= 30)
 select d.event_id, d.user_id, count(c.crawled_at) as crawls, count(c.crawled_at) > 0 as skipped from d left join c on d.user_id = c.user_id and crawled_at <= ts and crawled_at > ts - interval 1 day group by all""")
def stream_freshness(spark, sf_dir):
    """Which visits that fall due can be skipped, as their site was crawled within a day before: two streams joined by interval."""
    e, path = read(spark, sf_dir, "events"), folder(spark)
    beat = spark.sql("select -1L as user_id, -1L as event_id, timestamp '2100-01-01' as ts")  # moves the watermarks past all rows
    for name, at, rows in (("due", "due_at", e.filter("event_type = 'signup'")), ("crawls", "crawled_at", e.filter("event_type = 'view' and value >= 30"))):
        for n, part in enumerate((rows.select("user_id", "event_id", "ts"), beat)):
            part.withColumnRenamed("ts", at).coalesce(1).write.parquet(f"{path}/{name}/part={n}")
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}/part=*")
    out = telemetry.freshness(stream("due", "user_id long, event_id long, due_at timestamp"), stream("crawls", "user_id long, crawled_at timestamp"))
    rows = telemetry.drain(out, path).filter("event_id >= 0")
    return rows.groupBy("event_id", "user_id").agg(F.count("crawled_at").alias("crawls"), (F.count("crawled_at") > 0).alias("skipped"))


#: Kinds of links in the words of the pages, and a form at the end of each page, by its length: to sign in, to ask, one with nothing to see.
OFFERS = {"articles": ["/the$", "/der$", "^die$"], "joining": ["/and", "^et$"]}
FORMS = ['<form action="/account"><input name="p" type="password"></form>', '<form method="post" action="/get-quote"><input name="q"><select name="w"></select></form><script>fetch("/api/v2/rates")</script>', '<form action="/search"><input type="hidden" name="t"></form> Sign in with Google, Salesforce']
_OFFERED = f"(select page_id, url, html || [{', '.join(map(quoted, FORMS))}][length(html) % 3 + 1] as html from pages)"


def _sql_offers() -> str:
    tags = "(?is)<a\\b[^>]*\\bhref=\"[^\"]*\"[^>]*>.*?</a>"
    link = f"(select page_id, lower(regexp_extract(t, '(?i)\\bhref=\"([^\"]*)\"', 1)) as h, lower(trim(regexp_replace(regexp_replace(regexp_extract(t, '(?s)^<[^>]*>(.*)</[aA]>$', 1), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) as x from (select page_id, unnest(regexp_extract_all(html, '{tags}')) as t from o))"
    out = [f"select page_id, 'portal' as category, {quoted(k)} as feature_type from {link} where {sql_match('h', ps)} or {sql_match('x', ps)}" for k, ps in OFFERS.items()]
    out += ["select page_id, 'form', 'login' from o where contains(html, 'type=\"password\"')", "select page_id, 'form', 'quote' from o where contains(html, '/get-quote')", "select page_id, 'api', 'endpoint' from o where contains(html, '/api/v2/')"]
    out += [f"select page_id, 'integration', 'oauth' from v where regexp_matches(text, {quoted('(?s)' + p)})" for p in rules.OAUTH.values()]
    out += [f"select page_id, 'integration', {quoted('tms' if 'TM' in n or 'Software' in n else 'platform')} from v where regexp_matches(text, {quoted(p)}) or regexp_matches(low, {quoted(p)})" for n, p in rules.INTEGRATIONS.items()]
    return " union all ".join(out)


@R.add("site_features", f"with o as {_OFFERED}, v as (select page_id, lower(html) as low, lower({html.SQL_VISIBLE}) as text from o), f as ({_sql_offers()}) select regexp_extract(url, '^https?://([^/?#]+)', 1) as site, category, feature_type, count(*) as found, count(distinct page_id) as pages from f join pages using (page_id) group by all")
def site_features(spark, sf_dir):
    """What each site offers: features found and pages that show them."""
    page = read(spark, sf_dir, "pages")
    offered = page.select("page_id", F.concat("html", F.element_at(F.array(*map(F.lit, FORMS)), F.length("html") % 3 + 1)).alias("html"))
    site = page.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("site"))
    return features.features(offered, OFFERS).join(site, "page_id").groupBy("site", "category", "feature_type").agg(F.count(F.lit(1)).alias("found"), F.count_distinct("page_id").alias("pages"))
