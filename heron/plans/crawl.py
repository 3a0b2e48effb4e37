"""What a crawl does next: the frontier of each site, and site maps that name site maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.exprs import Registry, quoted
from heron.functions import frontier, sitemaps
from heron.plans import robots
from heron.plans.markup import numbered
from heron.plans.urls import pages

R = Registry()
ANCHOR = '<a href="(/[^"]*)"'

#: Site maps of every page {n}: a list, and an index that names it, two earlier ones and a later one, so that maps meet and go round.
LIST, INDEX = "https://maps.org/p{n}.xml", "https://maps.org/i{n}.xml"


def maps(spark, sf_dir):
    """source, xml: a list and an index for every page."""
    n = F.col("page_id")
    at = lambda k: F.concat(F.lit("<sitemap><loc>https://maps.org/i"), k.cast("string"), F.lit(".xml</loc></sitemap>"))
    named = F.concat(F.lit('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>'), numbered(LIST), F.lit("</loc></sitemap>"), at(F.floor(n / 2)), at(F.floor(n / 3)), F.when(n % 7 == 0, at(n * 2)).otherwise(""), F.lit("</sitemapindex>"))
    listed = F.concat(F.lit('<?xml version="1.0"?><urlset><url><loc>'), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc><lastmod>2024-01-02</lastmod></url></urlset>"))
    both = F.array(F.struct(numbered(LIST).alias("source"), listed.alias("xml")), F.struct(numbered(INDEX).alias("source"), named.alias("xml")))
    return pages(spark, sf_dir).select(F.explode(both).alias("m")).select("m.*")


_REACHED = """with recursive i as (select page_id as n, 'https://maps.org/i' || page_id || '.xml' as source from pages),
 e as (select source, 'https://maps.org/p' || n || '.xml' as child from i union select source, 'https://maps.org/i' || cast(floor(n / 2) as bigint) || '.xml' from i union select source, 'https://maps.org/i' || cast(floor(n / 3) as bigint) || '.xml' from i union select source, 'https://maps.org/i' || (n * 2) || '.xml' from i where n % 7 = 0),
 r as (select source as root, source, 0 as depth from i union select r.root, e.child, r.depth + 1 from r join e using (source) where r.depth < 3),
 d as (select root, source, min(depth) as depth from r group by all)"""


@R.add("sitemap_reach", f"{_REACHED} select root, source, depth from d")
def sitemap_reach(spark, sf_dir):
    """All maps that each index leads to within three steps, by the shortest way."""
    m = maps(spark, sf_dir)
    return sitemaps.reached(m, m.select("source").filter(F.col("source").like("%/i%")), 3)


@R.add("sitemap_tree_urls", f"{_REACHED} select root, url as loc, min(depth) as depth, '2024-01-02T00:00:00' as lastmod from d join (select 'https://maps.org/p' || page_id || '.xml' as source, trim(url) as url from pages) using (source) group by root, url")
def sitemap_tree_urls(spark, sf_dir):
    """The addresses that each index lists through all maps it leads to."""
    m = maps(spark, sf_dir)
    return sitemaps.all_urls(m, m.select("source").filter(F.col("source").like("%/i%")), 3)


def anchors(spark, sf_dir):
    """page_id, site, address, path, ofs of the links within each page's own site, in order."""
    of = robots.addresses(spark, sf_dir).select("page_id", F.col("domain").alias("site"))
    links = pages(spark, sf_dir).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("pos", "path"))
    return links.join(of, "page_id").select("page_id", "site", F.concat("site", "path").alias("address"), "path", (F.col("page_id") * 1000 + F.col("pos")).alias("ofs"))


_ENCODED = "replace(url_encode(o.path), '%2F', '/')"


@R.add("crawl_frontier", f"""{robots.SQL_RULES}, links as (select page_id, domain as site, domain || h as address, h as path, page_id * 1000 + k - 1 as ofs from (select page_id, unnest(regexp_extract_all(html, {quoted(ANCHOR)}, 1)) as h, generate_subscripts(regexp_extract_all(html, {quoted(ANCHOR)}, 1), 1) as k from pages) join a using (page_id)),
 named as (select a.domain as site, a.domain || '/' as address, '/' as path, 0 as rank, 0 as ofs from a union all select site, address, links.path, 1, ofs from links),
 once as (select site, address, any_value(named.path) as path, min(rank) as rank, arg_min(ofs, (rank, ofs)) as ofs from named group by site, address),
 new as (select * from once where (site, address) not in (select (site, address) from links where page_id % 3 = 0)),
 placed as (select site, address, row_number() over (partition by site order by rank, ofs, address) as place from new o where rank = 0 or coalesce((select arg_min(r.allow, r.pos) from rules r where r.domain = o.site and starts_with({_ENCODED}, replace(replace(r.path, '=', '%3D'), '#', '%23'))), true))
 select site, cast(place as int) as place, address from placed where place <= 50""")
def crawl_frontier(spark, sf_dir):
    """The next fifty addresses of each site: its root, then links in order of first sight that robots rules allow and no crawl has seen."""
    links = anchors(spark, sf_dir)
    seen = links.filter("page_id % 3 = 0").select("site", "address")  # what an earlier crawl is taken to have seen
    start = robots.addresses(spark, sf_dir).select(F.col("domain").alias("site"), F.concat("domain", F.lit("/")).alias("address"), F.lit("/").alias("path"), F.lit(0).cast("long").alias("ofs")).distinct()
    return frontier.frontier(start, links, seen, robots.files(spark, sf_dir), robots.AGENT, 50)
