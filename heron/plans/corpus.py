"""Corpus analytics: terms at several grains, typical sites, comparison, exports and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heron import rules
from heron.exprs import Registry, quoted, sql_first_match
from heron.functions import html as H
from heron.functions import text as T
from heron.functions import urls
from heron.plans.text import _sql_counts
from heron.plans.urls import HOST, P, pages

R = Registry()
TERMS = rules.SYNTHETIC_TERMS
TYPE = sql_first_match("lower(path)", rules.SYNTHETIC_PAGE_TYPES, "other")
#: One row a page, as DuckDB sees it.
SITES = f"(select page_id, url, html, {HOST} as host, {TYPE} as page_type, {H.SQL_VISIBLE} as text from {P})"
COUNTS = f"(select page_id, host, page_type, x.term as term, x.n as n from (select *, unnest({_sql_counts('lower(text)', TERMS)}) as x from {SITES}))"


def site_pages(spark, sf_dir) -> DataFrame:
    """page_id, url, host, page_type, text, html: the page rows of all sites."""
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", "url", "html", urls.host(u).alias("host"), urls.page_type(urls.path(u), rules.SYNTHETIC_PAGE_TYPES).alias("page_type"), H.visible(F.col("html")).alias("text"))


def page_terms(spark, sf_dir) -> DataFrame:
    return site_pages(spark, sf_dir).select("page_id", "host", "page_type", F.explode(T.term_counts(F.col("text"), TERMS)).alias("term", "n"))


@R.add("corpus_terms", f"select term, host, page_type, cast(sum(n) as bigint) as n from {COUNTS} group by grouping sets ((term), (term, host), (term, page_type))")
def corpus_terms(spark, sf_dir):
    """Term counts of the corpus, each site and each page type in one pass."""
    return page_terms(spark, sf_dir).groupingSets([["term"], ["term", "host"], ["term", "page_type"]], "term", "host", "page_type").agg(F.sum("n").alias("n"))


@R.add("corpus_category_terms", f"select category, term, cast(sum(n) as bigint) as n from (select host, term, sum(n) as n from {COUNTS} group by all) join (select host, unnest(case when len(host) % 2 = 0 then ['even', 'all'] else ['odd', 'all'] end) as category from (select distinct host from {COUNTS})) using (host) group by all")
def corpus_category_terms(spark, sf_dir):
    """A site in several categories counts in each."""
    sites = page_terms(spark, sf_dir).groupBy("host", "term").agg(F.sum("n").alias("n"))
    category = F.explode(F.when(F.length("host") % 2 == 0, F.array(F.lit("even"), F.lit("all"))).otherwise(F.array(F.lit("odd"), F.lit("all"))))
    return sites.select("term", "n", category.alias("category")).groupBy("category", "term").agg(F.sum("n").alias("n"))


@R.add("corpus_mean_site", f"select page_type, count(*) as pages, round_even(count(distinct host) / cast((select count(distinct host) from {SITES}) as double), 2) as prevalence, round_even(avg(len(regexp_extract_all(text, '\\S+'))), 0) as words from {SITES} group by page_type")
def corpus_mean_site(spark, sf_dir):
    """Page types with their share of sites and mean words."""
    rows = site_pages(spark, sf_dir).select("host", "page_type", F.regexp_count("text", F.lit(r"\S+")).alias("words"))
    sites = rows.agg(F.count_distinct("host").alias("sites"))
    by = rows.groupBy("page_type").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("on"), F.avg("words").alias("words"))
    return by.crossJoin(F.broadcast(sites)).select("page_type", "pages", F.bround(F.col("on") / F.col("sites"), 2).alias("prevalence"), F.bround("words", 0).alias("words"))


@R.add("corpus_site_average", f"select round_even(avg(n), 1) as pages_per_site, count(*) as sites from (select count(*) as n from {SITES} group by host)")
def corpus_site_average(spark, sf_dir):
    return site_pages(spark, sf_dir).groupBy("host").count().agg(F.bround(F.avg("count"), 1).alias("pages_per_site"), F.count(F.lit(1)).alias("sites"))


H1 = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


@R.add("corpus_headings", f"select lower({H1}) as heading, count(*) as n from pages where {H1} <> '' group by 1 order by n desc, heading limit 30")
def corpus_headings(spark, sf_dir):
    """The thirty most frequent first headings; equal counts in order of the heading."""
    h = pages(spark, sf_dir).select(F.lower(H.heading(F.col("html"))).alias("heading")).filter("heading <> ''")
    return h.groupBy("heading").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "heading").limit(30)


@R.add("corpus_home_heading", f"select host, arg_min(heading, page_id) as heading from (select page_id, host, {H1} as heading from {SITES}) where heading <> '' group by host")
def corpus_home_heading(spark, sf_dir):
    """First page with a heading of each site."""
    rows = site_pages(spark, sf_dir).select("page_id", "host", H.heading(F.col("html")).alias("heading")).filter("heading <> ''")
    return rows.groupBy("host").agg(F.min_by("heading", "page_id").alias("heading"))


@R.add("corpus_matrix", f"select host, {', '.join(f'cast(coalesce(sum(n) filter (where term = {quoted(t)}), 0) as bigint) as {quoted(t).replace(chr(39), chr(34))}' for t in TERMS)} from {COUNTS} group by host")
def corpus_matrix(spark, sf_dir):
    """Sites by terms, absent terms 0."""
    return page_terms(spark, sf_dir).groupBy("host").pivot("term", TERMS).sum("n").na.fill(0)


@R.add("corpus_term_lookup", f"select host, cast(sum(n) as bigint) as n from {COUNTS} where term = 'the' group by host having sum(n) > 0 order by n desc, host")
def corpus_term_lookup(spark, sf_dir):
    return page_terms(spark, sf_dir).filter("term = 'the'").groupBy("host").agg(F.sum("n").alias("n")).filter("n > 0").orderBy(F.desc("n"), "host")


@R.add("corpus_compare", f"select coalesce(a.term, b.term) as term, coalesce(a.n, 0) as english, coalesce(b.n, 0) as german from (select term, cast(sum(n) as bigint) as n from {COUNTS} where page_type = 'english' group by term) a full join (select term, cast(sum(n) as bigint) as n from {COUNTS} where page_type = 'german' group by term) b using (term)")
def corpus_compare(spark, sf_dir):
    """Two groups of pages by term, absent terms 0."""
    one = lambda kind: page_terms(spark, sf_dir).filter(F.col("page_type") == kind).groupBy("term").agg(F.sum("n").alias(kind))
    return one("english").join(one("german"), "term", "full").na.fill(0)


@R.add("export_pages", f"select page_id, host, url, substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 100) as title, page_type, len(regexp_extract_all(text, '\\S+')) as words, len(text) as chars, substr(sha256(html), 1, 16) as html_hash from {SITES}")
def export_pages(spark, sf_dir):
    """Flat page table with site context, as the CSV and JSON-lines exports write it."""
    return site_pages(spark, sf_dir).select("page_id", "host", "url", F.substring(H.title(F.col("html")), 1, 100).alias("title"), "page_type", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"), T.short_hash(F.col("html")).alias("html_hash"))


@R.add("export_summary", f"""select host, count(*) as pages, cast(sum(len(regexp_extract_all(text, '\\S+'))) as bigint) as words, array_to_string(list_sort(list_distinct(list(page_type))), ',') as page_types, array_to_string((list(page_id order by page_id))[1:10], ',') as sample,
 (select array_to_string(list(term order by n desc, term), ',') from (select term, sum(n) as n from {COUNTS} c where c.host = s.host group by term)) as terms from {SITES} s group by host""")
def export_summary(spark, sf_dir):
    """One row a site: metrics, page types, ranked terms and its first ten pages."""
    rows = site_pages(spark, sf_dir).select("host", "page_id", "page_type", F.regexp_count("text", F.lit(r"\S+")).alias("words"))
    sites = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("words").cast("long").alias("words"), F.array_join(F.sort_array(F.collect_set("page_type")), ",").alias("page_types"))
    place = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))  # limited before the shuffle, too
    first = rows.select("host", "page_id").withColumn("r", place).filter("r <= 10").groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("page_id")), ",").alias("sample"))
    terms = page_terms(spark, sf_dir).groupBy("host", "term").agg(F.sum("n").alias("n"))
    by_site = terms.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), lambda s: s["term"]), ",").alias("terms"))
    return sites.join(first, "host").join(by_site, "host", "left")


@R.add("report_labels", "select source, round_even(avg(quality), 2) as mean_quality, count(quality) as graded, sum(toxic) as toxic, round_even(100.0 * sum(quality) / count(quality), 1) as pct from labels join documents using (doc_id) group by source")
def report_labels(spark, sf_dir):
    """Scores by source, absent grades left out."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    j = read("labels").join(read("documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.bround(F.avg("quality"), 2).alias("mean_quality"), F.count("quality").alias("graded"), F.sum("toxic").alias("toxic"), F.bround(100.0 * F.sum("quality") / F.count("quality"), 1).alias("pct"))


@R.add("report_best_worst", "select source, mean, kind from (select source, mean, 'best' as kind, row_number() over (order by mean desc, source) as r from m union all select source, mean, 'worst', row_number() over (order by mean, source) from m) where r <= 3".replace(" m ", " (select source, avg(n_chars) as mean from documents group by source) ").replace("from m)", "from (select source, avg(n_chars) as mean from documents group by source))"))
def report_best_worst(spark, sf_dir):
    """Best and worst three sources by mean of means."""
    m = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.avg("n_chars").alias("mean"))
    best = m.orderBy(F.desc("mean"), "source").limit(3).withColumn("kind", F.lit("best"))
    return best.unionByName(m.orderBy("mean", "source").limit(3).withColumn("kind", F.lit("worst")))


@R.add("report_verdict", "select count(*) as sources, avg(mean) as avg_total, min(mean) as min_total, max(mean) as max_total, avg(mean) >= 6 and min(mean) >= 4 as passed, array_to_string(list(source order by source) filter (where mean < 7), ',') as failing from (select source, avg(quality) * 4 + avg(1 - toxic) * 4 as mean from labels join documents using (doc_id) group by source)")
def report_verdict(spark, sf_dir):
    """Scores of at most eight a source: passed with a mean of six and none under four; sources under seven are named."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    m = read("labels").join(read("documents").select("doc_id", "source"), "doc_id").groupBy("source").agg((F.avg("quality") * 4 + F.avg(1 - F.col("toxic")) * 4).alias("mean"))
    under = F.col("mean") < 7
    failing = F.array_join(F.sort_array(F.collect_list(F.when(under, F.col("source")))), ",")
    return m.agg(F.count(F.lit(1)).alias("sources"), F.avg("mean").alias("avg_total"), F.min("mean").alias("min_total"), F.max("mean").alias("max_total"), ((F.avg("mean") >= 6) & (F.min("mean") >= 4)).alias("passed"), F.when(F.count_if(under) > 0, failing).alias("failing"))


@R.add("report_facets", "select event_type, case when value > 50 then 'pass' else 'fail' end as status, count(*) as n, avg(nullif(value, 0)) as score from events group by rollup (1, 2)")
def report_facets(spark, sf_dir):
    """Counts by facet and status with totals; zero scores are left out of the mean."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("status", F.when(F.col("value") > 50, "pass").otherwise("fail"))
    return e.rollup("event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("value") != 0, F.col("value"))).alias("score"))
