"""URL queries over the pages table and fixture rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron import rules
from heron.exprs import Registry, quoted, sql_first_match, sql_match
from heron.functions import html, urls
from heron.functions import policy as P_

R = Registry()

# DuckDB parts of a URL: scheme, authority, path, query.
P = r"(select *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as authority, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query from pages)"
HOST = r"regexp_replace(lower(authority), '^www\.', '')"
TRIMMED = "regexp_replace(path, '/+$', '')"
QUERY = f"""(select coalesce(string_agg(k || '=' || v, '&' order by k, i), '') from (select split_part(p, '=', 1) as k, case when contains(p, '=') then substr(p, len(split_part(p, '=', 1)) + 2) else '' end as v, i from (select unnest(string_split(query, '&')) as p, generate_subscripts(string_split(query, '&'), 1) as i)) where k <> '' and lower(k) not in ({", ".join(map(quoted, rules.TRACKING_PARAMS))}))"""


def pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@R.add("url_canonical", f"select page_id, c.scheme || '://' || {HOST} || case when {TRIMMED} = '' then '/' else {TRIMMED} end || case when q = '' then '' else '?' || q end as canonical from (select *, {QUERY} as q from {P}) c")
def url_canonical(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@R.add("url_skip", f"select page_id, {sql_match('lower(url)', [e.replace('.', chr(92) + '.') + '$' for e in rules.SKIP_EXTENSIONS])} or {sql_match('lower(url)', rules.SKIP_PATTERNS)} as skipped, {sql_match('lower(path)', [e.replace('.', chr(92) + '.') + '$' for e in rules.SKIP_EXTENSIONS])} as skipped_by_path from {P}")
def url_skip(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", urls.skipped(u).alias("skipped"), urls.skipped_by_path(u).alias("skipped_by_path"))


@R.add("url_internal", f"select page_id, contains({HOST}, 'example') as internal, {HOST} as host from {P}")
def url_internal(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.internal(F.col("url"), F.lit("example")).alias("internal"), urls.host(F.col("url")).alias("host"))


@R.add("url_filename", f"""select page_id, substr(case when n = '' then 'index' else n end || case when query = '' then '' else '_' || substr(md5(query), 1, 8) end, 1, 200) || '.html' as name,
 case when s = '' then 'index' else substr(s, 1, 200) end || '.html' as safe_name from (select *, regexp_replace(regexp_replace(n, '[<>:"|?*]', '', 'g'), '\\.html?$', '') as s from (select *, replace(trim(path, '/'), '/', '_') as n from {P}))""")
def url_filename(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.filename(F.col("url")).alias("name"), urls.safe_filename(F.col("url")).alias("safe_name"))


@R.add("url_page_type", f"select page_id, {sql_first_match('lower(path)', rules.PAGE_TYPES, 'other')} as page_type, {sql_first_match('lower(path)', rules.SYNTHETIC_PAGE_TYPES, 'other')} as language_type from {P}")
def url_page_type(spark, sf_dir):
    p = urls.path(F.col("url"))
    return pages(spark, sf_dir).select("page_id", urls.page_type(p).alias("page_type"), urls.page_type(p, rules.SYNTHETIC_PAGE_TYPES).alias("language_type"))


SYNTHETIC_PRIORITIES = {"high": ["/en/"], "medium": ["/fr/", "/de/"], "low": ["\\.html$"]}
SCORE = f"""greatest(0, case level when 'high' then 100 when 'medium' then 75 when 'low' then 10 else 50 end - depth * 5 - len(list_filter(string_split(path, '/'), lambda s: s <> '')) * 2
 + case when path in ('/', '') then 20 when regexp_matches(path, '^/[^/]+/?$') then 10 else 0 end - case when regexp_matches(lower(path), '(page|p)=?\\d+') then 20 else 0 end - case when regexp_matches(lower(path), '\\.(pdf|doc|xls|ppt)') then 10 else 0 end - case when contains(path, '#') then 15 else 0 end)"""


@R.add("url_priority", f"select page_id, {sql_first_match('lower(path)', rules.PRIORITIES, 'normal')} as packed, level, {SCORE} as score from (select *, {sql_first_match('lower(path)', SYNTHETIC_PRIORITIES, 'normal')} as level, page_id % 3 as depth from {P})")
def url_priority(spark, sf_dir):
    p = urls.path(F.col("url"))
    score = urls.priority_score(p, (F.col("page_id") % 3).cast("int"), SYNTHETIC_PRIORITIES)
    return pages(spark, sf_dir).select("page_id", urls.priority(p).alias("packed"), urls.priority(p, SYNTHETIC_PRIORITIES).alias("level"), score.cast("long").alias("score"))


PRODUCTS = [("first", ["/en/[a-f]"], ["the", "of"]), ("second", ["/de/"], ["der", "und", "mit"]), ("third", [], ["que", "la"])]


@R.add("url_product", f"""select page_id, case {' '.join(f"when {sql_match('lower(path)', p) if p else 'false'} or {' + '.join(f'cast(contains(low, {quoted(t)}) as int)' for t in ts)} >= 2 then {quoted(n)}" for n, p, ts in PRODUCTS)} end as product from (select *, lower(html) as low from {P})""")
def url_product(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.product(urls.path(F.col("url")), F.col("html"), PRODUCTS).alias("product"))


SEEDS = "(values ('acme.com'), ('www.acme.com'), ('shop.acme.co.uk'), ('https://acme.com/x'), ('acme.com/en'), ('intranet'), (' spaced.com ')) as t(domain)"


@R.add("url_seeds", rf"""select domain, case when regexp_matches(d, '^https?://') then d when len(b) - len(replace(b, '.', '')) <= 1 and not starts_with(d, 'www.') then 'https://www.' || d else 'https://' || d end as start_url, replace(d, 'www.', '') as cache_key
 from (select *, split_part(d, '/', 1) as b from (select domain, trim(domain) as d from {SEEDS})) where d not like 'https:%'""")
def url_seeds(spark, sf_dir):
    seeds = spark.sql(f"select * from {SEEDS}").filter(~F.trim("domain").startswith("https:"))
    return seeds.select("domain", urls.start_url(F.col("domain")).alias("start_url"), urls.cache_key(F.trim("domain")).alias("cache_key"))


NAMES = "(values ('HTTP'), (' js '), ('playwright'), ('Playwright_Stealth'), ('headed'), ('no-headless'), ('manual'), ('patient'), ('visible'), ('auto'), ('odd')) as t(raw)"


def _sql_map(names: dict[str, str], default: str | None) -> str:
    return "case lower(trim(raw)) " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in names.items()) + f" else {quoted(default)} end"


@R.add("url_strategy_names", f"select raw, {_sql_map(urls.STRATEGIES, 'requests')} as strategy, {_sql_map(urls.METHODS, None)} as fetch_method from {NAMES}")
def url_strategy_names(spark, sf_dir):
    return spark.sql(f"select * from {NAMES}").select("raw", urls.mapped(F.col("raw"), urls.STRATEGIES, "requests").alias("strategy"), urls.mapped(F.col("raw"), urls.METHODS, None).alias("fetch_method"))


LABELS = "(values ('Our Services'), ('The Company'), ('View All Services'), ('About Us'), ('Who We Are'), ('Investors Home'), ('Services Overview'), ('Zebra'), ('Docs'), ('Discover Products')) as t(label)"


def sql_label(c: str) -> str:
    out = f"trim(lower({c}))"
    for p in rules.NAV_STRIP:
        out = f"trim(regexp_replace({out}, {quoted(p)}, '', 'g'))"
    return out


def sql_section(label: str) -> str:
    near = " ".join(f"when {' or '.join(f'contains({label}, {quoted(n)}) or contains({quoted(n)}, {label})' for n in names)} then {quoted(s)}" for s, names in rules.NAV_SYNONYMS.items())
    return f"case when {label} in ({', '.join(map(quoted, rules.NAV_SYNONYMS))}) then {label} {near} end"


@R.add("nav_labels", f"select label, l as normalized, {sql_section('l')} as section from (select label, {sql_label('label')} as l from {LABELS})")
def nav_labels(spark, sf_dir):
    return spark.sql(f"select * from {LABELS}").select("label", urls.nav_label(F.col("label")).alias("normalized"), urls.nav_section(F.col("label")).alias("section"))


@R.add("url_layers", "select page_id, case when page_id % 5 = 0 then 'cli' when page_id % 3 = 0 then 'run' when page_id % 2 = 0 then 'seed' else 'default' end as method, case when page_id % 3 = 0 then '5' else '3' end as delay, case when page_id % 2 = 0 then 'true' end as patient from pages")
def url_layers(spark, sf_dir):
    """Layers of settings merged by key: the strongest value that isn't null stays."""
    n = F.col("page_id")
    layer = lambda cond, **kv: F.when(cond, F.create_map(*(F.lit(x).cast("string") for k, v in kv.items() for x in (k, v))))
    m = P_.merged(layer(F.lit(True), method="default", delay="3"), layer(n % 2 == 0, method="seed", patient="true"), layer(n % 3 == 0, method="run", delay="5", patient=None), layer(n % 5 == 0, method="cli"))
    return pages(spark, sf_dir).select("page_id", m.alias("m")).select("page_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("method", "delay", "patient")))


@R.add("site_rollup", f"""select host, count(*) as pages, sum(words) as words, count(distinct canonical) as urls, max(page_type) as last_type, sum(len(html)) // 1024 as kb from
 (select {HOST} as host, html, len(regexp_extract_all({html.SQL_VISIBLE}, '\\S+')) as words, {HOST} || {TRIMMED} as canonical, {sql_first_match('lower(path)', rules.SYNTHETIC_PAGE_TYPES, 'other')} as page_type from {P}) group by host""")
def site_rollup(spark, sf_dir):
    """Sites by host: pages, visible words, distinct paths, size."""
    u = F.col("url")
    flat = pages(spark, sf_dir).select(urls.host(u).alias("host"), "html", html.word_count(F.col("html")).alias("words"), F.concat(urls.host(u), F.regexp_replace(urls.path(u), "/+$", "")).alias("canonical"), urls.page_type(urls.path(u), rules.SYNTHETIC_PAGE_TYPES).alias("page_type"))
    return flat.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("words").cast("long").alias("words"), F.count_distinct("canonical").alias("urls"), F.max("page_type").alias("last_type"), F.floor(F.sum(F.length("html")) / 1024).cast("long").alias("kb"))
