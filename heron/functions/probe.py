"""What a home page says of its site, in Columns over its own array of links and its marks.

Links are read once a page: those of its navigation bars (the whole page where it has none) make the
table of contents, all of them are counted. Everything else is whether a mark stands in the page, by
one alternation for each sign. No tree is built, so a page that closes its bars in another order than
it opens them is read up to the first closing tag.

Cases: null pages say nothing and have no links; null addresses resolve no link, so nothing is
internal. Pages are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron import rules
from heron.exprs import any_match
from heron.functions import detect, html, urls
from heron.functions.spans import bound

BAR = r"(?is)<(nav|header)\b.*?</\1\s*>"
LABEL = 50


def _host(url: Column) -> Column:
    return F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def _followed(base: Column, anchors: Column) -> Column:
    """(host, path, text) of the links that lead somewhere."""
    real = F.filter(anchors, lambda a: ~a["href"].rlike("^(#|javascript:|mailto:|tel:)"))

    def placed(a: Column) -> Column:
        return bound(urls.resolve(base, a["href"]), lambda u: F.struct(_host(u).alias("host"), F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", "").alias("path"), F.substring(a["text"], 1, LABEL).alias("text")))

    return F.transform(real, placed)


def contents(base: Column, page: Column) -> Column:
    """(text, url) of the bars' links to the site itself, a path once, the first with a label."""
    bars = bound(F.regexp_extract_all(page, F.lit(BAR), F.lit(0)), lambda b: F.when(F.size(b) == 0, F.array(page)).otherwise(b))
    own = F.filter(_followed(base, F.flatten(F.transform(bars, html.anchors))), lambda x: (x["host"] == _host(base)) & (x["text"] != ""))

    def once(rows: Column) -> Column:
        return bound(F.transform(rows, lambda x: x["path"]), lambda paths: F.filter(rows, lambda x, k: F.array_position(paths, x["path"]) == k + 1))

    return F.transform(bound(own, once), lambda x: F.struct(x["text"].alias("text"), F.when(x["path"] == "", "/").otherwise(x["path"]).alias("url")))


def probes(pages: DataFrame, technologies: dict[str, list[str]] = rules.TECHNOLOGIES, most: int = 50) -> DataFrame:
    """page_id, what each page (page_id, url, html) is made with, its contents, links and signs; `most` lines of contents."""
    low = F.lower("html")
    first = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    read = first.select("page_id", "url", "html", html.anchors(F.col("html")).alias("anchors"), contents(F.col("url"), F.col("html")).alias("nav"))
    read = read.withColumn("followed", _followed(F.col("url"), F.col("anchors")))
    meta = F.get(F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*\bname\s*=\s*[\"']generator[\"'][^>]*>"), F.lit(0)), F.lit(0))
    inside = F.size(F.filter("followed", lambda x: F.contains(x["host"], _host(F.col("url"))))).cast("int")
    deepest = F.array_max(F.transform(F.filter("nav", lambda x: x["url"] != "/"), lambda x: F.regexp_count(x["url"], F.lit("/"))))
    selector = F.lit(None).cast("string")
    for name, mark in reversed(rules.MAIN_MARKS.items()):
        selector = F.when(F.col("html").rlike(f"(?is){mark}"), name).otherwise(selector)
    return read.select(
        "page_id",
        detect.technologies(F.col("html"), technologies).alias("technologies"),
        F.substring(html.attribute(meta, "content"), 1, 100).alias("generator"),
        F.slice("nav", 1, most).alias("nav"),
        F.coalesce(deepest, F.lit(0)).cast("int").alias("nav_depth"),
        F.size("anchors").cast("int").alias("links"),
        inside.alias("internal_links"),
        (F.size("followed") - inside).cast("int").alias("external_links"),
        *(any_match(low, marks, "(?s)").alias(sign) for sign, marks in rules.PAGE_SIGNS.items()),
        selector.alias("main_selector"),
    )
