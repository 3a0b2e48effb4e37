"""Coverage, assets, features, enrichment and roll-ups of structured data."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from heron import rules
from heron.exprs import Registry, quoted, sql_any, sql_first_match, sql_labels, sql_match
from heron.functions import detect as D
from heron.functions import html as H
from heron.functions import media, records
from heron.functions import text as T
from heron.functions import urls
from heron.plans.access import OUTCOME, outcome, read
from heron.plans.links import ANCHORS, links
from heron.plans.text import SENTENCES, TOLD, documents, told
from heron.plans.planted import planted
from heron.plans.urls import HOST, PRODUCTS, P, pages

R = Registry()


def _sql_product(low: str) -> str:
    whens = []
    for n, ps, ts in PRODUCTS:
        path = sql_match("lower(path)", ps) if ps else "false"
        whens.append(f"when {path} or {' + '.join(f'cast(contains({low}, {quoted(t)}) as int)' for t in ts)} >= 2 then {quoted(n)}")
    return f"case {' '.join(whens)} end"


@R.add("product_coverage", f"select p.product, count(m.page_id) as pages, count(m.page_id) > 0 as covered, round_even((select count(distinct product) from (select {_sql_product('lower(html)')} as product from {P}) where product is not null) / 4.0::double, 2) as coverage from (select unnest(['first', 'second', 'third', 'fourth']) as product) p left join (select page_id, {_sql_product('lower(html)')} as product from {P}) m using (product) group by p.product")
def product_coverage(spark, sf_dir):
    """Pages of each product, those without pages too, and the share of products covered."""
    names = spark.createDataFrame([(n,) for n, *_ in PRODUCTS] + [("fourth",)], "product string")
    found = pages(spark, sf_dir).select("page_id", urls.product(urls.path(F.col("url")), F.col("html"), PRODUCTS).alias("product"))
    by = names.join(found, "product", "left").groupBy("product").agg(F.count("page_id").alias("pages"), (F.count("page_id") > 0).alias("covered"))
    every = Window.partitionBy(F.lit(1))  # as many rows as products are named
    return by.withColumn("coverage", F.bround(F.avg(F.col("covered").cast("double")).over(every), 2))


@R.add("frontier", f"select canonical, min(ofs) as ofs from (select lower(authority) || path as canonical, page_id as ofs from {P} where not regexp_matches(path, '^/de/') union all select lower(authority) || path, page_id + 100000 from {P}) group by canonical order by ofs, canonical limit 50")
def frontier(spark, sf_dir):
    """Start pages before discovered ones, each address once in order of first sight, fifty at most in all; crawl_frontier goes by site and robots rules."""
    u = F.col("url")
    all_ = pages(spark, sf_dir).select(F.concat(F.lower(urls.part(u, "AUTHORITY")), urls.path(u)).alias("canonical"), urls.path(u).alias("p"), "page_id")
    start = all_.filter(~F.col("p").rlike("^/de/")).select("canonical", F.col("page_id").alias("ofs"))
    rest = all_.select("canonical", (F.col("page_id") + 100000).alias("ofs"))
    return start.unionByName(rest).groupBy("canonical").agg(F.min("ofs").alias("ofs")).orderBy("ofs", "canonical").limit(50)


EXPECTED = "(values ('a', true, 5, 1000), ('b', false, 0, 0), ('c', true, 3, 500)) as t(id, success, least_pages, least_words)"
ACTUAL = "(values ('a', 6, 1200), ('b', 0, 45), ('c', 2, 80)) as t(id, pages, words)"


@R.add("fixture_checks", f"select id, array_to_string({sql_labels([('success', '(pages > 0 and words >= 100) <> success'), ('pages', 'pages < least_pages'), ('words', 'words < least_words')])}, ',') as failures from {EXPECTED} join {ACTUAL.replace('as t', 'as u')} using (id)")
def fixture_checks(spark, sf_dir):
    """Expected against actual, as a list of what differs."""
    j = spark.sql(f"select * from {EXPECTED}").join(spark.sql(f"select * from {ACTUAL}"), "id")
    failed = F.array(F.when(((F.col("pages") > 0) & (F.col("words") >= 100)) != F.col("success"), "success"), F.when(F.col("pages") < F.col("least_pages"), "pages"), F.when(F.col("words") < F.col("least_words"), "words"))
    return j.select("id", F.array_join(F.filter(failed, lambda x: x.isNotNull()), ",").alias("failures"))


@R.add("method_comparison", "select user_id % 5 as target, " + ", ".join(f"count(*) filter (where event_type = '{t}' and value >= 30) as \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + " from events group by 1")
def method_comparison(spark, sf_dir):
    """Successes of each method against each target."""
    e = read(spark, sf_dir, "events").filter("value >= 30").withColumn("target", F.col("user_id") % 5)
    return e.groupBy("target").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@R.add("outcome_counts", f"select {OUTCOME} as outcome, count(*) as n from events group by 1")
def outcome_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@R.add("site_totals", "select user_id, case when stored is null or (stored = 0 and n > 0) then words else stored end as total from (select user_id, case when user_id % 3 = 0 then null when user_id % 3 = 1 then 0 else 7 end as stored, count(*) as n, cast(sum(floor(value)) as bigint) as words from events group by user_id)")
def site_totals(spark, sf_dir):
    """Stored totals, recomputed where they are missing or 0 beside pages."""
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("words"))
    stored = F.when(F.col("user_id") % 3 == 1, 0).when(F.col("user_id") % 3 == 2, 7)
    return by.select("user_id", F.when(stored.isNull() | ((stored == 0) & (F.col("n") > 0)), F.col("words")).otherwise(stored).alias("total"))


@R.add("page_features", f"select page_id, anchors, api from (select page_id, (select count(*) from {ANCHORS} a where a.page_id = p.page_id and regexp_matches(lower(href), '/e')) as anchors, len(list_distinct(regexp_extract_all(html, '/api/v\\d+/'))) as api from pages p)")
def page_features(spark, sf_dir):
    """Features of a page as one row: matching anchors, endpoints."""
    p = pages(spark, sf_dir)
    hit = links(spark, sf_dir).filter(F.lower("href").rlike("/e")).groupBy("page_id").agg(F.count(F.lit(1)).alias("anchors"))
    return p.select("page_id", F.size(D.api_endpoints(F.col("html"))).cast("long").alias("api")).join(hit, "page_id", "left").na.fill(0, ["anchors"])


@R.add("homepage_probe", f"select page_id, count(href) as links, count(distinct href) as distinct_links, max(len(list_filter(string_split(regexp_replace(href, '[?#].*$', ''), '/'), lambda x: x <> ''))) as depth, bool_or(regexp_matches(lower(html), 'cookie-consent|gdpr')) as cookie_banner, bool_or(regexp_matches(lower(href), '/login|/account')) as login from pages left join (select page_id, href from {ANCHORS}) using (page_id) group by page_id")
def homepage_probe(spark, sf_dir):
    """Navigation and technology signs of a page, from its own array of links."""
    low = F.lower("html")
    p = pages(spark, sf_dir).select("page_id", F.transform(H.anchors(F.col("html")), lambda a: a["href"]).alias("h"), low.rlike("cookie-consent|gdpr").alias("cookie_banner"))
    steps = F.transform("h", lambda h: F.size(F.filter(F.split(F.regexp_replace(h, "[?#].*$", ""), "/"), lambda x: x != "")))
    login = F.exists("h", lambda h: F.lower(h).rlike("/login|/account"))
    return p.select("page_id", F.size("h").cast("long").alias("links"), F.size(F.array_distinct("h")).cast("long").alias("distinct_links"), F.array_max(steps).cast("long").alias("depth"), "cookie_banner", F.when(F.size("h") > 0, login).alias("login"))


BUCKETS = {"drivers": ["cdl", "driver"], "owner_operators": ["owner operator", "lease"], "shippers": ["quote", "shipper"]}


def buckets(text: Column) -> Column:
    """Array of (bucket, snippet): the first six distinct sentences of each bucket."""
    return F.flatten(F.array(*(_snippets(text, bucket, kws) for bucket, kws in BUCKETS.items())))


def _snippets(text: Column, bucket: str, keywords: list[str]) -> Column:
    return F.transform(F.slice(F.array_distinct(T.sentences_with(text, keywords)), 1, 6), lambda s: F.struct(F.lit(bucket).alias("bucket"), s.alias("snippet")))


@R.add("page_buckets", " union all ".join(f"select doc_id, {quoted(b)} as bucket, unnest(list_distinct(list_filter({SENTENCES}, lambda x: {sql_any('lower(x)', ks)})[1:5])) as snippet from {TOLD}" for b, ks in BUCKETS.items()))
def page_buckets(spark, sf_dir):
    return told(spark, sf_dir).select("doc_id", F.explode(buckets(F.col("text"))).alias("b")).select("doc_id", "b.*")


@R.add("enriched_pages")
def enriched_pages(spark, sf_dir):
    """Everything the text functions say of a text, as one record a document."""
    return enriched(spark, sf_dir, "doc_id")


def enriched(spark, sf_dir, *keys: str):
    """keys of each document with its record."""
    t = F.col("text")
    return told(spark, sf_dir, *(k for k in keys if k != "doc_id")).select(*keys, T.money(t).alias("money"), T.dates(t).alias("dates"), T.locations(t).alias("locations"), T.keyword_groups(t).alias("keywords"), T.urgency(t).alias("urgency"), T.sentiment(t).alias("sentiment"), T.audience(t).alias("audience"))


_MATCHES = " + ".join(f"len(regexp_extract_all(text, {quoted('(?i)' + p)}))" for p, _ in rules.MONEY)
_DATED = " + ".join(f"len(regexp_extract_all(text, {quoted('(?i)' + p)}))" for p in rules.DATES)
_GROUPED = " + ".join(f"cast({sql_any('lower(text)', ks)} as int)" for ks in rules.COMPENSATION.values())
_URGENT = " or ".join(f"regexp_matches(lower(text), {quoted(p)})" for p in rules.URGENCY)


@R.add("enriched_summary", f"select source, count(*) as pages, sum({_MATCHES})::bigint as amounts, sum({_DATED})::bigint as dates, count(*) filter (where {_URGENT}) as urgent, sum({_GROUPED})::bigint as groups from {TOLD} t join (select doc_id, source from documents) d using (doc_id) group by source")
def enriched_summary(spark, sf_dir):
    """Amounts, dates, urgent pages and pay groups of each source: counted, without places and contexts."""
    t = F.col("text")
    e = told(spark, sf_dir, "source").select("source", F.size(T.raws(t, rules.MONEY)).alias("money"), F.size(T.raws(t, [(p, "date") for p in rules.DATES])).alias("dates"), T.urgent(t).alias("urgent"), T.keyword_group_count(t).alias("groups"))
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("money").alias("amounts"), F.sum("dates").alias("dates"), F.count_if("urgent").alias("urgent"), F.sum("groups").alias("groups"))


PLAYBOOKS = "(values ('acme.com', 'js'), ('www.b.org', 'visible')) as t(domain, max_strategy)"
FLAGS = "(values ('requests', false, false, false), ('js', true, false, false), ('stealth', true, true, false), ('stealth_patient', true, true, false), ('visible', true, false, true)) as t(strategy, browser, stealth, headed)"


@R.add("playbook_lookup", f"select d.domain, coalesce(a.max_strategy, b.max_strategy) as max_strategy, f.browser, f.headed from (values ('acme.com'), ('www.acme.com'), ('www.b.org'), ('c.net')) as d(domain) left join {PLAYBOOKS.replace('as t', 'as a')} on a.domain = d.domain left join {PLAYBOOKS.replace('as t', 'as b')} on b.domain = regexp_replace(d.domain, '^www\\.', '') left join {FLAGS.replace('as t', 'as f')} on f.strategy = coalesce(a.max_strategy, b.max_strategy)")
def playbook_lookup(spark, sf_dir):
    """Rules of a domain: exact, then without www.; with the flags of the strategy they name."""
    d = spark.sql("select * from (values ('acme.com'), ('www.acme.com'), ('www.b.org'), ('c.net')) as t(domain)")
    books = spark.sql(f"select * from {PLAYBOOKS}")
    exact = d.join(F.broadcast(books.withColumnRenamed("max_strategy", "x")), "domain", "left")
    near = exact.withColumn("bare", F.regexp_replace("domain", r"^www\.", "")).join(F.broadcast(books.select(F.col("domain").alias("bare"), F.col("max_strategy").alias("y"))), "bare", "left")
    named = near.select("domain", F.coalesce("x", "y").alias("max_strategy"))
    flags = spark.sql(f"select * from {FLAGS}").withColumnRenamed("strategy", "max_strategy")
    return named.join(F.broadcast(flags), "max_strategy", "left").select("domain", "max_strategy", "browser", "headed")


@R.add("sites_selected", "with t as (select c_custkey from customer where c_nationkey = 7 and c_custkey not in (7, 32)), s as (select c_custkey from t order by sha256(c_custkey || ':3'), c_custkey limit 8) select c_custkey from s union select 4242")
def sites_selected(spark, sf_dir):
    """A seeded sample of a tier without the skipped sites; a known hard one is always in."""
    t = read(spark, sf_dir, "customer").filter("c_nationkey = 7").select("c_custkey").filter(~F.col("c_custkey").isin(7, 32))
    s = t.orderBy(F.sha2(F.concat(F.col("c_custkey").cast("string"), F.lit(":3")), 256), "c_custkey").limit(8)
    return s.unionByName(spark.range(4242, 4243).select(F.col("id").alias("c_custkey"))).distinct()


CLASSES = [("language-python", "python", 1.0), ("hljs lang-js", "javascript", 1.0), ("highlight-source-rb", "ruby", 1.0), ("yml-code", "yaml", 0.9), ("hljs golang", "go", 0.9), ("prism-sh", "bash", 0.9), ("brush: plain", "text", 0.8), ("syntax-kt", "kotlin", 0.8), ("code-md", "markdown", 0.7), ("plain", None, None)]


@R.add("code_classes", "select * from (values " + ", ".join(f"({quoted(c)}, {quoted(n)}, {'null' if x is None else x}::double)" for c, n, x in CLASSES) + ") as t(class, language, confidence)")
def code_classes(spark, sf_dir):
    """Language that a class names, with how sure that is."""
    c = spark.createDataFrame([(c,) for c, *_ in CLASSES], "class string")
    found = [F.when(F.col("class").rlike(f"(?i){p}"), F.struct(F.lower(F.regexp_extract("class", f"(?i){p}", 1)).alias("language"), F.lit(x).alias("confidence"))) for p, x in media.LANGUAGE_CLASSES]
    names = F.create_map(*(F.lit(x) for kv in media.ALIASES.items() for x in kv))
    best = c.select("class", F.coalesce(*found).alias("f"))
    return best.select("class", F.coalesce(names[F.col("f.language")], F.col("f.language")).alias("language"), "f.confidence")


@R.add("backoff_and_expiring", f"select event_id, greatest(1.0::double, d + d * (event_id * 17 % 89 / 89.0::double * 0.4::double - 0.2::double)) as delay, (event_id * 7919 % 40000000 - 500000) between 0 and 604800 as expiring from (select event_id, least((case when event_id % 6 = 0 or {OUTCOME} in ('soft_block', 'challenge_not_cleared') then 8.0::double + event_id * 31 % 97 / 97.0::double * 12.0::double else 3.0::double end) * pow(2, event_id % 8), 120.0::double) as d from events)")
def backoff_and_expiring(spark, sf_dir):
    """Delay before the next attempt, its random parts from the event's number, and whether a cookie expires within a week."""
    n = F.col("event_id")
    e = n * 7919 % 40000000 - 500000
    share = lambda k, m: n * k % m / float(m)
    return read(spark, sf_dir, "events").select("event_id", D.next_delay(n % 8, F.lit(3.0), n % 6 == 0, outcome(), share(31, 97), share(17, 89)).alias("delay"), e.between(0, 604800).alias("expiring"))


def _region(name: str):
    return lambda b: b["block_type"] == f"{name}_block"


@R.add("site_report", f"""select host, count(*) as pages, cast(sum(words) as bigint) as words, count(*) - count(distinct hash) as duplicates, count(*) filter (where page_type = 'english') as english, cast(4 * count(*) as bigint) as nav_blocks, cast(count(*) as bigint) as hero_blocks, cast(2 * count(*) as bigint) as footer_blocks, round_even(count(distinct word) / 3.0::double, 2) as nav_coverage from
 (select *, unnest(case when len(found) = 0 then [null] else found end) as word from (select {HOST} as host, page_id, len(regexp_extract_all({H.SQL_VISIBLE}, '\\S+')) as words, sha256(html) as hash, {sql_first_match('lower(path)', rules.SYNTHETIC_PAGE_TYPES, 'other')} as page_type, list_filter(['services', 'resources', 'about'], lambda x: x = 'services') as found from {P})) group by host""")
def site_report(spark, sf_dir):
    """A site's report as one record: totals, duplicates, a page type, blocks by region and the share of expected sections found."""
    u = F.col("url")
    own = pages(spark, sf_dir).select("page_id", urls.host(u).alias("host"), H.word_count(F.col("html")).alias("words"), F.sha2("html", 256).alias("hash"), urls.page_type(urls.path(u), rules.SYNTHETIC_PAGE_TYPES).alias("page_type"))
    blocks = records.records(planted(spark, sf_dir)).select("page_id", *(F.size(F.filter("tagged", _region(k))).alias(f"{k}_blocks") for k in ("nav", "hero", "footer")), F.exists("primary_nav", lambda x: F.contains(F.lower(x["text"]), F.lit("services"))).alias("services"))
    by = own.join(blocks, "page_id").groupBy("host")
    return by.agg(F.count(F.lit(1)).alias("pages"), F.sum("words").cast("long").alias("words"), (F.count(F.lit(1)) - F.count_distinct("hash")).alias("duplicates"), F.count_if(F.col("page_type") == "english").alias("english"), *(F.sum(f"{k}_blocks").alias(f"{k}_blocks") for k in ("nav", "hero", "footer")), F.bround(F.bool_or("services").cast("double") / 3, 2).alias("nav_coverage"))
