"""Tree, JSON-LD, sitemap, robots and code queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.exprs import Registry, quoted
from heron.functions import markup as M
from heron.functions import html as H
from heron.functions import records
from heron.plans.detect import cases, sql_cases
from heron.plans.planted import golden
from heron.plans.urls import pages

R = Registry()


@R.add("html_anchor_blocks", r"select page_id, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref=\x22[^\x22]+\x22[^>]*>.*?</a>')) as tag from pages) group by page_id")
def html_anchor_blocks(spark, sf_dir):
    """Anchors of the element tree; the oracle finds them by pattern."""
    return records.anchor_counts(pages(spark, sf_dir)).filter("n > 0").select("page_id", "n")


@R.add("html_body_words", rf"select page_id, len(regexp_extract_all({H.SQL_VISIBLE.replace("coalesce(html, '')", "regexp_replace(html, '(?is)^.*?<body[^>]*>', '')")}, '\S+')) as words from pages")
def html_body_words(spark, sf_dir):
    """Words of the element tree's body; the oracle strips tags by pattern."""
    return records.anchor_counts(pages(spark, sf_dir)).select("page_id", "words")


# JSON-LD that is planted in every page, {n} its number; the SQL holds what comes of it.
LD = [
    '<script type="application/ld+json">{"@graph": [{"@type": "Organization", "name": "Acme {n}", "logo": {"url": "/l{n}.png"}, "numberOfEmployees": {"value": 12}, "sameAs": "https://s.org/{n}", "address": {"addressLocality": "Ulm"}}, {"@type": ["Product", "Thing"], "name": "Box {n}", "brand": "B", "offers": [{"price": "9.5"}]}]}</script>',
    '<script type="application/ld+json">[{"@type": "BreadcrumbList", "itemListElement": [{"position": 2, "name": "Two {n}"}, {"position": 1, "item": {"name": "One"}}]}, {"@type": "FAQPage", "mainEntity": [{"name": "Why {n}?", "acceptedAnswer": {"text": "So."}}, {"acceptedAnswer": {"text": "x"}}]}]</script>',
    '<script type="application/ld+json">{"@type": "Organization", "name": broken</script>',
    '<script type="application/ld+json">{"@type": "WebSite", "name": "S{n}", "url": "u", "potentialAction": {"target": "u?q={q}"}}</script>',
    '<script type="application/ld+json">[{"@type": "Service", "name": "Haul", "provider": {"name": "Acme {n}"}}, {"@type": "Service", "name": "Haul", "provider": "x"}, {"@type": "LocalBusiness", "name": "Yard", "priceRange": "$$", "geo": {"latitude": 1.5, "longitude": 2}, "contactPoint": {"telephone": "1", "contactType": "sales"}}]</script>',
]


def numbered(text: str):
    return F.replace(F.lit(text), F.lit("{n}"), F.col("page_id").cast("string"))


def ld_items(spark, sf_dir):
    """page_id, pos, v: the JSON-LD items of every page."""
    html = F.concat(numbered("".join(LD)), F.coalesce("html", F.lit("")))
    return pages(spark, sf_dir).select("page_id", F.posexplode(M.items(html)).alias("pos", "v"))


@R.add("jsonld_items", golden("pos item_type name", [(0, "organization", "Acme {n}"), (1, "product", "Box {n}"), (2, "breadcrumblist", None), (3, "faqpage", None), (4, None, None), (5, "website", "S{n}"), (6, "service", "Haul"), (7, "service", "Haul"), (8, "localbusiness", "Yard")]))
def jsonld_items(spark, sf_dir):
    return ld_items(spark, sf_dir).select("page_id", "pos", M.item_type(F.col("v")).alias("item_type"), M.text_of(F.col("v"), "$.name").alias("name"))


@R.add("jsonld_organizations", golden("name logo employees city same_as", [("Acme {n}", "/l{n}.png", 12, "Ulm", "https://s.org/{n}")]))
def jsonld_organizations(spark, sf_dir):
    """The last organisation of a page wins."""
    o = ld_items(spark, sf_dir).filter(M.item_type(F.col("v")) == "organization").groupBy("page_id").agg(F.max_by(M.organization(F.col("v")), "pos").alias("o"))
    return o.select("page_id", "o.name", "o.logo", "o.employees", "o.address.city", F.array_join("o.same_as", ",").alias("same_as"))


@R.add("jsonld_lists", golden("trail question answer product brand price", [("One > Two {n}", "Why {n}?", "So.", "Box {n}", "B", "9.5")]))
def jsonld_lists(spark, sf_dir):
    """Trail, questions and product of a page."""
    v, kind = F.col("v"), M.item_type(F.col("v"))
    last = lambda name, c: F.max_by(F.when(kind == name, c), F.when(kind == name, F.col("pos")))
    p = ld_items(spark, sf_dir).groupBy("page_id").agg(last("breadcrumblist", F.array_join(M.breadcrumbs(v), " > ")).alias("trail"), last("faqpage", M.questions(v)).alias("q"), last("product", M.product(v)).alias("p"))
    return p.select("page_id", "trail", F.explode("q").alias("q"), "p").select("page_id", "trail", "q.*", F.col("p.name").alias("product"), "p.brand", "p.price")


@R.add("jsonld_sites", golden("item_type name search_target provider price_range latitude contact", [("website", "S{n}", "u?q={q}", None, None, None, None), ("service", "Haul", None, "Acme {n}", None, None, None), ("localbusiness", "Yard", None, None, "$$", 1.5, "sales")]))
def jsonld_sites(spark, sf_dir):
    """Web sites, services and local businesses; of services with one name the first stays."""
    v = F.col("v")
    g = lambda *p: M.text_of(v, *p)
    i = ld_items(spark, sf_dir).filter(M.item_type(v).isin("website", "service", "localbusiness"))
    rows = i.select("page_id", M.item_type(v).alias("item_type"), g("$.name").alias("name"), F.struct("pos", g("$.potentialAction.target").alias("search_target"), g("$.provider.name").alias("provider"), g("$.priceRange").alias("price_range"), F.try_variant_get(v, "$.geo.latitude", "double").alias("latitude"), g("$.contactPoint[0].contactType", "$.contactPoint.contactType").alias("contact")).alias("r"))
    return rows.groupBy("page_id", "item_type", "name").agg(F.min("r").alias("r")).select("page_id", "item_type", "name", "r.*").drop("pos")


SITE_OF = "page_id % 9"


@R.add("structured_rollup", f"""select {SITE_OF} as site, 'Acme ' || min(page_id) as organization, 'https://s.org/' || min(page_id) as social_links, 'S' || min(page_id) as website, 'Yard' as local_business, 'Haul' as services, count(*) as products, count(*) as questions, count(*) as broken from pages group by 1""")
def structured_rollup(spark, sf_dir):
    """Structured data of a site as one record: the first organisation, web site and business by page, services, products and questions once by name.

    Distinct names are counted and joined after a grouping by name, so no page's items are gathered.
    """
    v, kind, site = F.col("v"), M.item_type(F.col("v")), F.expr(SITE_OF).alias("site")
    name = M.text_of(v, "$.name")
    rows = ld_items(spark, sf_dir).select(site, F.struct("page_id", "pos").alias("at"), kind.alias("kind"), name.alias("name"), M.organization(v)["same_as"].alias("same_as"), M.questions(v).alias("questions"), v.isNull().alias("broken"))
    first = lambda k, c: F.min_by(F.when(F.col("kind") == k, c), F.when(F.col("kind") == k, F.col("at")))
    once = rows.groupBy("site").agg(first("organization", F.col("name")).alias("organization"), F.array_join(first("organization", F.col("same_as")), ",").alias("social_links"), first("website", F.col("name")).alias("website"), first("localbusiness", F.col("name")).alias("local_business"), F.count_if("broken").alias("broken"))
    said = rows.select("site", "at", F.explode(F.when(F.col("kind") == "faqpage", F.transform("questions", lambda q: F.struct(F.lit("question").alias("kind"), q["question"].alias("name")))).when(F.col("kind").isin("service", "product"), F.array(F.struct("kind", "name")))).alias("x"))
    names = said.filter("x.name is not null").groupBy("site", "x.kind", "x.name").agg(F.min("at").alias("at"))
    lists = names.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "service", F.struct("at", "name")))), lambda s: s["name"]), ",").alias("services"), F.count_if(F.col("kind") == "product").alias("products"), F.count_if(F.col("kind") == "question").alias("questions"))
    return once.join(lists, "site")


# Site maps of every page: a list of addresses, one without a namespace, and an index.
XML = [
    ("a{n}", '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.org/{n} </loc><lastmod>2024-01-02</lastmod><priority>0.8</priority></url><url><loc>https://a.org/b{n}</loc><lastmod>soon</lastmod><priority>high</priority></url><url><loc></loc></url></urlset>'),
    ("b{n}", '<?xml version="1.0"?><urlset><url><loc>https://b.org/{n}</loc><changefreq>daily</changefreq><lastmod>2024-01-02T03:04:05Z</lastmod></url></urlset>'),
    ("i{n}", '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://a.org/s{n}.xml</loc></sitemap><sitemap><loc> https://a.org/t{n}.xml</loc></sitemap></sitemapindex>'),
]


def maps(spark, sf_dir):
    """source, xml: three site maps for every page."""
    listed = F.array(*(F.struct(numbered(s).alias("source"), numbered(x).alias("xml")) for s, x in XML))
    return pages(spark, sf_dir).select("page_id", F.explode(listed).alias("m")).select("m.*")


def _named(rows: str) -> str:
    return f"select * exclude (page_id) from ({rows})"


@R.add("sitemap_urls", _named(golden("source loc lastmod changefreq priority", [("a{n}", "https://a.org/{n}", "2024-01-02T00:00:00", None, 0.8), ("a{n}", "https://a.org/b{n}", "soon", None, None), ("b{n}", "https://b.org/{n}", "2024-01-02T03:04:05+00:00", "daily", None)])))
def sitemap_urls(spark, sf_dir):
    return M.sitemap_urls(maps(spark, sf_dir))


@R.add("sitemap_children", _named(golden("source loc is_sitemap", [("i{n}", "https://a.org/s{n}.xml", True), ("i{n}", "https://a.org/t{n}.xml", True)])))
def sitemap_children(spark, sf_dir):
    m = maps(spark, sf_dir)
    return M.sitemap_children(m).join(m.select("source", M.is_sitemap(F.col("xml")).alias("is_sitemap")), "source")


@R.add("sitemap_summary", _named(golden("source urls first_urls", [("a{n}", 2, "https://a.org/b{n},https://a.org/{n}"), ("b{n}", 1, "https://b.org/{n}")])))
def sitemap_summary(spark, sf_dir):
    """Each sitemap with its count and first hundred addresses."""
    u = M.sitemap_urls(maps(spark, sf_dir))
    return u.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("urls"), F.array_join(F.reverse(F.slice(F.sort_array(F.collect_list("loc")), 1, 100)), ",").alias("first_urls"))


# Robots files of every page's own domains.
ROBOTS = [("a{n}.org", "# all\nUser-agent: *\nDisallow: /private\nCrawl-delay: 2.5\nSitemap: https://a.org/{n}.xml\n\nUser-agent: Other\nDisallow: /\nCrawl-delay: 9\nSitemap: https://a.org/{n}.xml"), ("b{n}.org", "User-agent: heronbot\nDisallow:\nDisallow: /x{n}")]


def robots_files(spark, sf_dir):
    listed = F.array(*(F.struct(numbered(d).alias("domain"), numbered(c).alias("content")) for d, c in ROBOTS))
    return pages(spark, sf_dir).select("page_id", F.explode(listed).alias("r")).select("r.*")


@R.add("robots_rules", _named(golden("domain crawl_delay sitemaps disallowed", [("a{n}.org", 2.5, "https://a.org/{n}.xml", "/private"), ("b{n}.org", None, "", "/x{n}")])))
def robots_rules(spark, sf_dir):
    r = M.robots(robots_files(spark, sf_dir), "heronbot")
    return r.select("domain", "crawl_delay", F.array_join("sitemaps", ",").alias("sitemaps"), F.array_join("disallowed", ",").alias("disallowed"))


@R.add("robots_allowed", _named(golden("domain path", [("a{n}.org", "/open"), ("b{n}.org", "/private/1"), ("c{n}.org", "/private/1")])))
def robots_allowed(spark, sf_dir):
    """Paths that no rule forbids; a domain without a file forbids none."""
    listed = F.array(*(F.struct(numbered(d).alias("domain"), numbered(p).alias("path")) for d, p in (("a{n}.org", "/open"), ("a{n}.org", "/private/1"), ("b{n}.org", "/private/1"), ("b{n}.org", "/x{n}/y"), ("c{n}.org", "/private/1"))))
    paths = pages(spark, sf_dir).select("page_id", F.explode(listed).alias("p")).select("p.*")
    return M.allowed(paths, robots_files(spark, sf_dir), "heronbot").select("domain", "path")


@R.add("robots_delay", _named(golden("domain delay", [("a{n}.org", 2.5), ("b{n}.org", 1.0), ("c{n}.org", 1.0)])))
def robots_delay(spark, sf_dir):
    """Crawl delay, or the default where a domain names none or has no file."""
    domains = pages(spark, sf_dir).select("page_id", F.explode(F.array(*map(numbered, ("a{n}.org", "b{n}.org", "c{n}.org")))).alias("domain")).select("domain")
    held = M.robots(robots_files(spark, sf_dir), "heronbot").select("domain", "crawl_delay")
    return domains.join(held, "domain", "left").select("domain", F.coalesce("crawl_delay", F.lit(1.0)).alias("delay"))


CODES = "(values (1, 'import os\nprint(os.name)'), (2, 'const x = 1; console.log(x)'), (3, 'SELECT a FROM b'), (4, 'short'), (5, 'plain words only here'), (6, '{\"a\": 1, \"b\": 2}'), (7, 'fn main() { let mut v = 1; }'), (8, '#!/bin/bash'), (9, '.box { color: red }')) as t(id, code)"


@R.add("code_languages", f"select event_id, case when len(code) >= 10 then (list_sort(list_filter([{', '.join(f'case when regexp_matches(code, {quoted("(?mi)" + p)}) then struct_pack(c := -{c}::double, i := {i}, l := {quoted(n)}) end' for i, (p, n, c) in enumerate(M.LANGUAGES))}], lambda x: x is not null))[1]).l end as language from {sql_cases(CODES, 9)}")
def code_languages(spark, sf_dir):
    """Language that a code looks like, for every event one of nine codes."""
    return cases(spark, sf_dir, CODES, 9).select("event_id", M.language(F.col("code"))["language"].alias("language"))
