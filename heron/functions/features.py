"""What a page offers, as rows of features with a confidence, in Columns: portals, forms, sign-in, integrations, endpoints.

Links, forms and texts are each read once a page; a feature is a row for each link, form or name that
shows it, so sums by page or site are plain groupings.

Cases: null pages offer nothing. A form without a field that is seen is none. Forms that don't close
are read to the end of the page's last form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron import rules
from heron.exprs import any_match
from heron.functions import html
from heron.functions.spans import bound

# What a form's address says it is for, the first that occurs, and where programs are called.
PURPOSES = {"tracking": "track|trace|pro", "quote": "quote|rate", "search": "search", "contact": "contact|email"}
ENDPOINTS = [r"fetch\(['\"]/api/[^'\"]+", r"axios\.[a-z]+\(['\"]/api/[^'\"]+", r"['\"]https?://[^'\"]*api[^'\"]*['\"]", r"/api/v\d+/", "graphql"]
FEATURE = "array<struct<category:string,feature_type:string,confidence:double>>"


def feature(category: str, kind: Column, confidence: Column) -> Column:
    return F.struct(F.lit(category).alias("category"), kind.alias("feature_type"), confidence.cast("double").alias("confidence"))


def portals(anchors: Column, packs: dict[str, list[str]]) -> Column:
    """A feature for each link and kind of portal that its address or its text names."""

    def kinds(a: Column) -> Column:
        return F.filter(F.array(*(F.when(any_match(F.lower(a["href"]), ps) | any_match(F.lower(a["text"]), ps), kind) for kind, ps in packs.items())), lambda k: k.isNotNull())

    return F.transform(F.flatten(F.transform(anchors, kinds)), lambda k: feature("portal", k, F.lit(0.8)))


def forms(page: Column) -> Column:
    """A feature for each form that is for something, with a field that is seen."""

    def one(form: Column) -> Column:
        kind = lambda tag: F.coalesce(F.lower(html.attribute(tag, "type")), F.lit("text"))
        kinds = F.transform(F.regexp_extract_all(form, F.lit(r"(?is)<(?:input|select|textarea)\b[^>]*>"), F.lit(0)), kind)
        action = F.lower(F.coalesce(html.attribute(F.regexp_extract(form, "(?is)^<form[^>]*>", 0), "action"), F.lit("")))
        purpose = F.lit(None).cast("string")
        for name, pattern in reversed(PURPOSES.items()):
            purpose = F.when(action.rlike(pattern), name).otherwise(purpose)

        def judged(k: Column) -> Column:
            secret = F.array_contains(k, "password")
            seen = F.exists(k, lambda x: ~x.isin("hidden", "submit", "button"))
            return F.when(seen, feature("form", F.when(secret, "login").otherwise(purpose), F.when(secret, 0.7).otherwise(0.5)))

        return bound(kinds, judged)

    found = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<form\b[^>]*>.*?</form\s*>"), F.lit(0)), one)
    return F.filter(found, lambda f: f["feature_type"].isNotNull())


def _named(conditions: list[tuple[Column, Column]]) -> Column:
    return F.filter(F.array(*(F.when(c, f) for c, f in conditions)), lambda f: f.isNotNull())


def features(pages: DataFrame, packs: dict[str, list[str]] = rules.PORTALS) -> DataFrame:
    """page_id, category, feature_type, confidence: a row for each feature of pages (page_id, html)."""
    first = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    read = first.select("page_id", "html", F.lower("html").alias("low"), F.lower(html.visible(F.col("html"))).alias("text"), html.anchors(F.col("html")).alias("anchors"))
    text, low = F.col("text"), F.col("low")
    signed = _named([(text.rlike(f"(?s){p}"), feature("integration", F.lit("oauth"), F.lit(0.9))) for p in rules.OAUTH.values()])
    partners = _named([(text.rlike(p) | low.rlike(p), feature("integration", F.lit("tms" if "TM" in n or "Software" in n else "platform"), F.lit(0.6))) for n, p in rules.INTEGRATIONS.items()])
    called = _named([(any_match(F.col("html"), ENDPOINTS, "(?i)"), feature("api", F.lit("endpoint"), F.lit(0.7)))])
    every = F.concat(*(c.cast(FEATURE) for c in (portals(F.col("anchors"), packs), forms(F.col("html")), signed, partners, called)))
    return read.select("page_id", F.explode(every).alias("f")).select("page_id", "f.*")
