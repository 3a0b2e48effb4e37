"""Link, asset and navigation queries: anchors exploded into rows, rules joined as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heron import rules
from heron.exprs import Registry, any_match, labels_where, quoted, sql_match
from heron.functions import html as H
from heron.functions import urls
from heron.plans.urls import HOST, P, sql_label, pages

R = Registry()

TEXT = r"trim(regexp_replace(regexp_replace(regexp_extract(tag, '(?s)^<[^>]*>(.*)</[aA]>$', 1), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
TAGS = r"""(select *, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>.*?</a>')) as tag from """ + P + ")"
ANCHORS = rf"""(select page_id, host, scheme, authority, path, regexp_extract(tag, '(?i)\bhref="([^"]*)"', 1) as href, {TEXT} as text from (select *, {HOST} as host from {TAGS}))"""
FULL = """case when regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then h when starts_with(h, '//') then scheme || ':' || h when starts_with(h, '/') then scheme || '://' || authority || h when h = '' then scheme || '://' || authority || path when starts_with(h, '?') then scheme || '://' || authority || path || h
 else scheme || '://' || authority || regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || h end"""
LINKS = rf"""(select *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') as link_host from (select *, {FULL} as url from (select *, regexp_replace(trim(href), '#.*$', '') as h from {ANCHORS})))"""


def links(spark, sf_dir) -> DataFrame:
    return links_of(pages(spark, sf_dir))


def links_of(rows: DataFrame) -> DataFrame:
    """page_id, host, pos, href, text, url (resolved), link_host of pages: one row an anchor."""
    p = rows.select("page_id", F.col("url").alias("base"), F.posexplode(H.anchors(F.col("html"))).alias("pos", "a"))
    full = p.select("page_id", "base", urls.host(F.col("base")).alias("host"), "pos", "a.href", "a.text", urls.resolve(F.col("base"), F.col("a.href")).alias("url"))
    return full.withColumn("link_host", urls.host(F.col("url")))


@R.add("link_rows", f"select page_id, href, text, count(*) as n from {ANCHORS} group by all")
def link_rows(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page_id", "href", "text").agg(F.count(F.lit(1)).alias("n"))


@R.add("link_internal", f"select distinct page_id, url from {LINKS} where link_host = host and not regexp_matches(href, '^(#|javascript:|mailto:|tel:)')")
def link_internal(spark, sf_dir):
    """Distinct links of a page to its own site, without fragments."""
    return links(spark, sf_dir).filter((F.col("link_host") == F.col("host")) & ~F.col("href").rlike("^(#|javascript:|mailto:|tel:)")).select("page_id", "url").distinct()


KIND = r"case when regexp_matches(lower(regexp_replace(href, '[?#].*$', '')), '\.(pdf|doc|docx|xls|xlsx|ppt|pptx)$') then 'documents' when len(text) < 4 then 'nav' when link_host <> '' and link_host <> host then 'external' else 'content' end"


@R.add("link_kinds", f"select host, {KIND} as kind, count(*) as n, count(distinct url) as distinct_urls from {LINKS} group by all")
def link_kinds(spark, sf_dir):
    """Links of each site by kind; short labels stand for navigation in the synthetic pages."""
    kind = H.link_kind(F.col("href"), F.length("text") < 4, F.col("host"), F.col("link_host"))
    return links(spark, sf_dir).groupBy("host", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("distinct_urls"))


PARTNER = "'<a href=\"https://partner' || page_id % 7 || '.example.org/x\">Partner</a>'"


@R.add("link_graph", f"select host as src, link_host as dst, count(*) as links, count(distinct page_id) as pages from {LINKS.replace('from pages)', f'from (select page_id, url, html || {PARTNER} as html from pages))')} where link_host <> '' and link_host <> host group by all")
def link_graph(spark, sf_dir):
    """Links between sites; every page has one planted link to a partner."""
    n = (F.col("page_id") % 7).cast("string")
    rows = pages(spark, sf_dir).withColumn("html", F.concat("html", F.lit('<a href="https://partner'), n, F.lit('.example.org/x">Partner</a>')))
    out = links_of(rows).filter("link_host <> '' and link_host <> host")
    return out.groupBy(F.col("host").alias("src"), F.col("link_host").alias("dst")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))


PORTALS = {"english": ["/en"], "numbered": ["[0-9]{3}"], "french": ["/fr", "fr-?ench"]}


@R.add("link_portals", " union all ".join(f"select page_id, {quoted(n)} as portal, count(*) as n from {LINKS} where {sql_match('lower(href)', ps)} or {sql_match('lower(text)', ps)} group by page_id" for n, ps in PORTALS.items()))
def link_portals(spark, sf_dir):
    """Anchors by portal rule; each rule is a literal pattern, so nothing is joined."""
    held = labels_where((n, any_match(F.lower("href"), ps) | any_match(F.lower("text"), ps)) for n, ps in PORTALS.items())
    return links(spark, sf_dir).select("page_id", F.explode(held).alias("portal")).groupBy("page_id", "portal").agg(F.count(F.lit(1)).alias("n"))


# Feature, URL patterns, text patterns and priority: fitted to the synthetic anchors.
HINTS = [("english", ["/en/"], ["^the"], 0), ("numbers", ["/[0-9]+$"], ["and$"], 1), ("other", [".*"], [], 2)]


def _hint_rows() -> str:
    return " union all ".join(f"select page_id, url, sub, ofs, {i} as rule, {p} as priority, {quoted(f)} as feature from l where {sql_match('lower(url)', u)}{' or ' + sql_match('lower(text)', t) if t else ''}" for i, (f, u, t, p) in enumerate(HINTS))


@R.add("link_hints", f"with l as (select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as sub, row_number() over () as ofs from {LINKS}) select page_id, sub as subtree, feature, priority from (select *, row_number() over (partition by page_id, sub order by rule) as r from ({_hint_rows()}) where sub <> '') where r = 1")
def link_hints(spark, sf_dir):
    """Subtrees worth a deeper look: the first rule that names a subtree wins."""
    found = [F.when(any_match(F.lower("url"), u) | (any_match(F.lower("text"), t) if t else F.lit(False)), F.struct(F.lit(i).alias("rule"), F.lit(f).alias("feature"), F.lit(p).alias("priority"))) for i, (f, u, t, p) in enumerate(HINTS)]
    hit = links(spark, sf_dir).withColumn("subtree", urls.path(F.col("url"))).filter("subtree <> ''").select("page_id", "subtree", F.coalesce(*found).alias("h")).filter("h is not null")
    return hit.groupBy("page_id", "subtree").agg(F.min("h").alias("h")).select("page_id", "subtree", "h.feature", "h.priority")


EXPECTED = ["the", "of", "zebra", "andante"]


@R.add("nav_coverage", f"""select host, expected, tier, min(text) as label from (select *, min(tier) over (partition by host, expected) as best from (select host, text, expected, case when contains(lower(text), expected) then 1 when contains(n, expected) or (n <> '' and contains(expected, n)) then 2 end as tier from
 (select host, text, {sql_label('text')} as n from {ANCHORS} where text <> ''), (select unnest([{', '.join(map(quoted, EXPECTED))}]) as expected)) where tier is not null) where tier = best group by all""")
def nav_coverage(spark, sf_dir):
    """Expected sections among a site's labels: found directly, else in or around a normalised label; the first label in order of name."""
    x, n = F.col("expected"), urls.nav_label(F.col("text"))
    labels = links(spark, sf_dir).filter("text <> ''").select("host", "text", n.alias("n")).distinct().withColumn("expected", F.explode(F.array(*map(F.lit, EXPECTED))))
    tier = F.when(F.contains(F.lower("text"), x), 1).when(F.contains("n", x) | ((F.col("n") != "") & F.contains(x, F.col("n"))), 2)
    best = labels.withColumn("tier", tier).filter("tier is not null").groupBy("host", "expected").agg(F.min(F.struct("tier", "text")).alias("m"))
    return best.select("host", "expected", "m.tier", F.col("m.text").alias("label"))


@R.add("nav_sections", f"select expected, label, method from (select e as expected, label, method, row_number() over (partition by e order by tier, pos) as r from (select e, label, pos, case when contains(lower(label), e) then 1 when contains(n, e) or contains(e, n) then 2 when s = e then 3 end as tier, case tier when 1 then 'direct' when 2 then 'normalized' when 3 then 'synonym' end as method from (values (1, 'Our Services', 'services', 'services'), (2, 'Who We Are', 'who we are', 'about'), (3, 'View All Tools', 'tools', 'resources'), (4, 'Tech', 'tech', 'technology')) as t(pos, label, n, s), (select unnest([{', '.join(map(quoted, rules.EXPECTED_SECTIONS))}]) as e)) where tier is not null) where r = 1")
def nav_sections(spark, sf_dir):
    """Three tiers of matches of expected sections: direct, normalised, by synonym."""
    labels = spark.createDataFrame([(1, "Our Services"), (2, "Who We Are"), (3, "View All Tools"), (4, "Tech")], "pos int, label string")
    e = labels.withColumn("expected", F.explode(F.array(*map(F.lit, rules.EXPECTED_SECTIONS))))
    n, x = urls.nav_label(F.col("label")), F.col("expected")
    tier = F.when(F.contains(F.lower("label"), x), 1).when(F.contains(n, x) | F.contains(x, n), 2).when(urls.nav_section(F.col("label")) == x, 3)
    best = e.withColumn("tier", tier).filter("tier is not null").groupBy("expected").agg(F.min_by(F.struct("label", "tier"), F.struct("tier", "pos")).alias("m"))
    return best.select("expected", "m.label", F.element_at(F.array(F.lit("direct"), F.lit("normalized"), F.lit("synonym")), F.col("m.tier")).alias("method"))


# Cases of source, size and name, with the page's number for {n}.
IMAGES = [
    ('<img src="/a{n}/logo.png" alt="Acme" width="120" height="40">', "/a{n}/logo.png", 120, 40, "logo", False), ('<img data-src="https://x.org/photo{n}.jpg" src="" width="800px" height="600">', "https://x.org/photo{n}.jpg", None, 600, "unknown", False),
    ("<img src='/spacer.gif' width='1' height='1'>", "/spacer.gif", 1, 1, "unknown", True), ('<img src="/i/icon-cart.svg" alt="Cart">', "/i/icon-cart.svg", None, None, "icon", True),
    ('<img src="/x.png" alt="" width="40" height="40">', "/x.png", 40, 40, "unknown", True), ('<img src="/flow-chart.png" alt="Flow" width="x" height="300">', "/flow-chart.png", None, 300, "diagram", False),
    ('<img src="/rule{n}.png" alt="rule" width="600" height="2">', "/rule{n}.png", 600, 2, "unknown", False), ('<img data-background="/bg{n}.jpg" src="/blank.gif" width=" 640 " height="480">', "/bg{n}.jpg", 640, 480, "photo", False), ('<img src="/y.png" width="0" height="3">', "/y.png", 0, 3, "unknown", False),
]


def _sql_images() -> str:
    put = lambda v: "null" if v is None else f"replace({quoted(v)}, '{{n}}', page_id::varchar)" if isinstance(v, str) else str(v).lower()
    return " union all ".join(f"select page_id, {i} as pos, " + ", ".join(f"{put(v)} as {c}" for c, v in zip(("src", "width", "height", "kind", "decorative"), row, strict=True)) + " from pages" for i, (_, *row) in enumerate(IMAGES))


@R.add("image_kinds", _sql_images())
def image_kinds(spark, sf_dir):
    """Source, size and kind of images planted in every page, without a tree; the SQL holds what they must be."""
    html = F.concat(F.replace(F.lit("".join(t for t, *_ in IMAGES)), F.lit("{n}"), F.col("page_id").cast("string")), F.coalesce("html", F.lit("")))
    tags = pages(spark, sf_dir).select("page_id", F.posexplode(H.images(html)).alias("pos", "tag"))
    rows = tags.select("page_id", "pos", H.lazy_source(F.col("tag")).alias("src"), H.attribute(F.col("tag"), "alt").alias("alt"), H.dimension(H.attribute(F.col("tag"), "width")).alias("width"), H.dimension(H.attribute(F.col("tag"), "height")).alias("height"))
    c = [F.col(x) for x in ("src", "alt", "width", "height")]
    return rows.select("page_id", "pos", "src", "width", "height", H.image_kind(*c).alias("kind"), H.decorative(*c).alias("decorative"))


@R.add("page_projection", f"select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, {H.SQL_VISIBLE} as text, substr(sha256(trim(regexp_replace(html, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g'))), 1, 16) as content_hash from pages")
def page_projection(spark, sf_dir):
    h = F.col("html")
    return pages(spark, sf_dir).select("page_id", H.title(h).alias("title"), H.visible(h).alias("text"), H.content_hash(h).alias("content_hash"))
