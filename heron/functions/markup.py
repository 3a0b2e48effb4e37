"""JSON-LD, sitemaps, robots files and code languages, with built-in JSON, XML and window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (pattern, language, confidence), the first of equals wins.
LANGUAGES = [
    (r">>>\s", "python", 0.8), (r"^\s*(def |class |import |from .+ import |if __name__|async def )", "python", 0.7), (r"print\(|self\.|\.append\(|\.items\(\)|\.get\(|\.keys\(\)", "python", 0.5), ("pip install|python -m|python3", "python", 0.6),
    (r"^\s*(const |let |var |function |=>|import .+ from |export )", "javascript", 0.7), (r"console\.log|document\.|window\.|\.addEventListener", "javascript", 0.5), (r":\s*(string|number|boolean|interface |type )", "typescript", 0.6),
    (r"^\s*(fn |let mut |impl |pub fn |use |mod )", "rust", 0.7), (r"\.unwrap\(\)|\.expect\(|&str|&mut|Option<|Result<", "rust", 0.5), (r"^\s*(func |package |import \(|type .+ struct)", "go", 0.7), (r":= |fmt\.Print|\.Error\(\)", "go", 0.5),
    (r"^\s*(public |private |protected |class |interface |@Override)", "java", 0.7), (r"System\.out\.print|\.equals\(|new [A-Z]", "java", 0.5), (r"^\s*(#include |int main|void |printf\()", "c", 0.6), ("std::|cout|cin|#include <iostream>|nullptr", "cpp", 0.6),
    (r"^\s*(def |end$|require |class .+ < |attr_accessor)", "ruby", 0.7), (r"\.each do|puts |\.nil\?|\.map \{", "ruby", 0.5), (r"^\s*(<\?php|\$[a-z_]+\s*=|function .+\()", "php", 0.7), (r"\$this->|->|echo |require_once", "php", 0.5),
    (r"^\s*(SELECT |INSERT |UPDATE |DELETE |CREATE TABLE|ALTER TABLE)", "sql", 0.8), (r"\bFROM\b|\bWHERE\b|\bJOIN\b|\bGROUP BY\b", "sql", 0.5), (r"^\s*<!DOCTYPE|<html|<head|<body|<div", "html", 0.7), (r"<[a-z]+[^>]*>.*</[a-z]+>", "html", 0.4),
    (r"^\s*(@media|@import|@keyframes|@font-face)", "css", 0.7), (r"\{\s*(color|background|margin|padding|font-|display|position)\s*:", "css", 0.6), (r"\.([\w-]+)\s*\{", "css", 0.4),
    (r"^\s*[\[{]", "json", 0.3), (r'"[^"]+"\s*:\s*["\d\[\{]', "json", 0.5), (r"^\s*[a-z_]+:\s*($|\n|[\"'\d\[])", "yaml", 0.5), (r"^\s*- [a-z_]+:", "yaml", 0.4), (r"^\s*\$\s+\w", "bash", 0.7), (r"^\s*(#!/bin/|if \[\[|for .+ in|while |export |echo \$)", "bash", 0.7), (r"\$\{|\|\||&&|sudo |apt-get|apt |npm |pip |brew ", "bash", 0.4), ("cat |trafilatura |curl |wget ", "bash", 0.5),
    (r"^\s*(#{1,6} |```|\*\*|__|\[.+\]\(.+\))", "markdown", 0.6),
]


def language(code: Column, rules: list[tuple[str, str, float]] = LANGUAGES) -> Column:
    """Struct (language, confidence) of the strongest rule; null for codes under ten characters or without a match."""
    hits = [F.when(code.rlike(f"(?mi){p}"), F.struct(F.lit(c).alias("confidence"), F.lit(-i).alias("i"), F.lit(name).alias("language"))) for i, (p, name, c) in enumerate(rules)]
    best = F.array_max(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    return F.when(F.length(code) >= 10, F.when(best.isNotNull(), F.struct(best["language"].alias("language"), best["confidence"].alias("confidence"))))


def cleaned(code: Column) -> Column:
    """Struct (code, truncated): code without leading line numbers, unless that takes over half of it; ends in an ellipsis."""
    bare = F.array_join(F.transform(F.split(code, "\n"), lambda s: F.regexp_replace(s, r"^\s*\d+[\s:]+", "")), "\n")
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.struct(trim(F.when(F.length(bare) * 2 < F.length(code), code).otherwise(bare)).alias("code"), trim(code).rlike(r"\.\.\.$|…$|# \.\.\.|// \.\.\.").alias("truncated"))


def items(html: Column) -> Column:
    """Array of JSON-LD items as VARIANT: graphs and lists are opened, broken scripts are null."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))

    def opened(s: Column) -> Column:
        v = F.try_parse_json(F.trim(s))
        graph = F.try_variant_get(v, "$.@graph", "array<variant>")
        listed = F.try_variant_get(v, "$", "array<variant>")
        return F.coalesce(graph, listed, F.array(v))

    return F.flatten(F.transform(scripts, opened))


def item_type(v: Column) -> Column:
    return F.lower(F.coalesce(F.try_variant_get(v, "$.@type[0]", "string"), F.try_variant_get(v, "$.@type", "string")))


def text_of(v: Column, *paths: str) -> Column:
    """First of the paths that holds text."""
    return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))


def organization(v: Column) -> Column:
    g = lambda *p: text_of(v, *p)
    place = F.struct(g("$.address.streetAddress").alias("street"), g("$.address.addressLocality").alias("city"), g("$.address.addressRegion").alias("region"), g("$.address.postalCode").alias("postal_code"), g("$.address.addressCountry").alias("country"))
    employees = F.coalesce(F.try_variant_get(v, "$.numberOfEmployees.value", "int"), F.try_variant_get(v, "$.numberOfEmployees", "int"))
    same = F.coalesce(F.try_variant_get(v, "$.sameAs", "array<string>"), F.transform(F.filter(F.array(g("$.sameAs")), lambda x: x.isNotNull()), lambda x: x))
    return F.struct(g("$.name").alias("name"), g("$.url").alias("url"), g("$.logo.url", "$.logo[0]", "$.logo").alias("logo"), g("$.telephone").alias("telephone"), place.alias("address"), employees.alias("employees"), same.alias("same_as"))


def breadcrumbs(v: Column) -> Column:
    """Names in order of position: its own, its item's, or the item itself."""
    entries = F.try_variant_get(v, "$.itemListElement", "array<variant>")
    rows = F.transform(entries, lambda e, i: F.struct(F.coalesce(F.try_variant_get(e, "$.position", "int"), F.lit(0)).alias("p"), i.alias("i"), text_of(e, "$.name", "$.item.name", "$.item").alias("n")))
    return F.filter(F.transform(F.array_sort(rows), lambda r: r["n"]), lambda n: n.isNotNull())


def questions(v: Column) -> Column:
    entries = F.try_variant_get(v, "$.mainEntity", "array<variant>")
    rows = F.transform(entries, lambda e: F.struct(text_of(e, "$.name").alias("question"), text_of(e, "$.acceptedAnswer.text").alias("answer")))
    return F.filter(rows, lambda r: r["question"].isNotNull())


def product(v: Column) -> Column:
    g = lambda *p: text_of(v, *p)
    return F.struct(g("$.name").alias("name"), g("$.sku").alias("sku"), g("$.brand.name", "$.brand").alias("brand"), g("$.offers[0].price", "$.offers.price").alias("price"), g("$.image[0]", "$.image.url", "$.image").alias("image"))


def sitemap_urls(maps: DataFrame, most: int = 10000) -> DataFrame:
    """source, loc, lastmod, changefreq, priority of urlset documents (source, xml), with or without a namespace; most a document."""
    parsed = F.from_xml("xml", "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>", {"ignoreNamespace": "true"})
    rows = maps.select("source", F.posexplode(parsed["url"]).alias("pos", "u")).filter((F.col("pos") < most) & (F.trim("u.loc") != ""))
    return rows.select("source", F.trim("u.loc").alias("loc"), lastmod(F.col("u.lastmod")).alias("lastmod"), F.trim("u.changefreq").alias("changefreq"), F.expr("try_cast(u.priority as double)").alias("priority"))


def sitemap_children(maps: DataFrame) -> DataFrame:
    """source, loc: the sitemaps that an index names, with or without a namespace; broken XML names none."""
    parsed = F.from_xml("xml", "sitemap array<struct<loc:string>>", {"ignoreNamespace": "true"})
    return maps.select("source", F.explode(parsed["sitemap"]["loc"]).alias("loc")).withColumn("loc", F.trim("loc")).filter("loc <> ''")


def lastmod(c: Column) -> Column:
    """ISO form of the usual formats; other text as it is."""
    bare = F.trim(c)
    day = F.date_format(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")), "yyyy-MM-dd'T'00:00:00")
    return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.coalesce(day, bare)).when(bare.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.regexp_replace(bare, "Z$", "+00:00")).otherwise(bare)


def is_sitemap(content: Column) -> Column:
    head = F.lower(F.substring(content, 1, 500))
    return F.contains(head, F.lit("<?xml")) & (F.contains(head, F.lit("urlset")) | F.contains(head, F.lit("sitemapindex")))


def robots_lines(files: DataFrame, agent: str) -> DataFrame:
    """domain, pos, directive, value, ours: rules of robots files (domain, content); ours follows the last user-agent line."""
    lines = files.select("domain", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.contains("line", F.lit(":")))
    rules = lines.select("domain", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("directive"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    name = F.when(F.col("directive") == "user-agent", F.lower("value"))
    last = F.last(name, ignorenulls=True).over(Window.partitionBy("domain").orderBy("pos"))
    low = agent.lower()
    return rules.withColumn("agent", last).withColumn("ours", F.coalesce((F.col("agent") == "*") | F.contains("agent", F.lit(low)) | F.contains(F.lit(low), F.col("agent")), F.lit(False))).drop("agent")


def robots(files: DataFrame, agent: str, most: int = 20) -> DataFrame:
    """domain, crawl_delay (the last), sitemaps (distinct), disallowed (the first, most of them)."""
    r = robots_lines(files, agent)
    d, ours = F.col("directive"), F.col("ours")
    delay = F.expr("try_cast(value as double)")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c & (F.col("value") != ""), F.struct("pos", "value")))), lambda s: s["value"])
    return r.groupBy("domain").agg(F.max_by(F.when((d == "crawl-delay") & ours, delay), F.when((d == "crawl-delay") & ours & delay.isNotNull(), F.col("pos"))).alias("crawl_delay"), F.array_distinct(listed(d == "sitemap")).alias("sitemaps"), F.slice(listed((d == "disallow") & ours), 1, most).alias("disallowed"))


def allowed(paths: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """paths (domain, path) that no disallow prefix of ours covers: a plain reading of the listed rules. What a crawler may fetch is robots.decisions()."""
    rules = robots_lines(files, agent).filter("directive = 'disallow' and ours and value <> ''").select("domain", F.col("value").alias("prefix"))
    return paths.join(rules, (paths["domain"] == rules["domain"]) & F.expr("startswith(path, prefix)"), "left_anti")
