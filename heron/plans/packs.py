"""A rule pack for each site, from profile files, joined as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.exprs import Registry, quoted
from heron.functions import packs
from heron.plans.robots import addresses
from heron.session import folder

R = Registry()

#: The pack of sites with none of their own, and that of a site, where {n} is how many pages it has.
DEFAULT = {"page_type": {"feed": ["utm_source=feed"], "german": ["^/de/"], "file": [r"\.html$", r"\.pdf$"], "any": ["."]}, "product": {"seven": [r"/\d*7\d*/?$"]}}
OWN = {"page_type": {"english": ["^/EN/"], "listing": [r"page=\d+", r"\?q="], "top": ["#top"]}, "product": {"own {n}": [r"/[a-z]{2}/\d*{n}"], "rest": ["/fr/", "/es/"]}}


def profiles(spark, sf_dir):
    """The profile files of every second site of the pages, by the length of its name, and the default one; read back as rules."""
    path = folder(spark)
    shape = F.replace(F.lit(_json(OWN)), F.lit("{n}"), (F.count(F.lit(1)) % 10).cast("string"))
    own = addresses(spark, sf_dir).filter("length(domain) % 2 = 0").groupBy("domain").agg(shape.alias("rules"))
    named = own.unionByName(spark.createDataFrame([("default", _json(DEFAULT))], "domain string, rules string"))
    named.select(F.concat(F.lit('{"name": "'), "domain", F.lit('", "rules": '), "rules", F.lit("}")).alias("value")).write.text(path)
    return packs.read(spark, path)


def _json(rules: dict) -> str:
    import json

    return json.dumps(rules)


def _sql(rules: dict, kind: str, n: str) -> str:
    cases = " ".join(f"when regexp_matches(path, {quoted('(?i)' + p)}) then {quoted(label)}" if "{n}" not in p else f"when regexp_matches(path, replace({quoted('(?i)' + p)}, '{{n}}', {n})) then replace({quoted(label)}, '{{n}}', {n})" for label, ps in rules[kind].items() for p in ps)
    return f"case {cases} end"


_OF = """(select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as domain, regexp_replace(url, '^https?://[^/?#]+', '') as path, cast(count(*) over (partition by regexp_extract(url, '^https?://([^/?#]+)', 1)) % 10 as varchar) as n from pages)"""


@R.add("pack_labels", "select page_id, " + ", ".join(f"case when length(domain) % 2 = 0 then {_sql(OWN, k, 'n')} else {_sql(DEFAULT, k, 'n')} end as {k}" for k in ("page_type", "product")) + f" from {_OF}")
def pack_labels(spark, sf_dir):
    """Page type and product of every page by the pack of its own site."""
    pages = addresses(spark, sf_dir).withColumnRenamed("domain", "site")
    return packs.labels(pages, profiles(spark, sf_dir), ["page_type", "product"]).select("page_id", "page_type", "product")


@R.add("pack_coverage", f"""with l as (select domain, n, {_sql(OWN, 'product', 'n')} as product from {_OF} where length(domain) % 2 = 0),
 w as (select distinct domain, unnest(['own ' || n, 'rest']) as product from l)
 select w.domain as site, w.product, count(l.product) as pages, count(l.product) > 0 as covered from w left join l on w.domain = l.domain and w.product = l.product group by all""")
def pack_coverage(spark, sf_dir):
    """How many pages of its site each product of a pack has, those without any too."""
    rules = profiles(spark, sf_dir).filter("kind = 'product' and pack <> 'default'")
    wanted = rules.select(F.col("pack").alias("site"), F.col("label").alias("product")).distinct()
    pages = addresses(spark, sf_dir).withColumnRenamed("domain", "site")
    found = packs.labels(pages, rules, ["product"]).filter("product is not null").groupBy("site", "product").agg(F.count(F.lit(1)).alias("pages"))
    return wanted.join(found, ["site", "product"], "left").select("site", "product", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("pages").isNotNull().alias("covered"))


@R.add("pack_rules", f"""with d as (select distinct domain, n from {_OF} where length(domain) % 2 = 0), r as (select * from (values {", ".join(f"({quoted(k)}, {quoted(label)}, {quoted(p)})" for k, of in OWN.items() for label, ps in of.items() for p in ps)}) as t(kind, label, pattern))
 select domain as pack, kind, replace(label, '{{n}}', n) as label, replace(pattern, '{{n}}', n) as pattern from d, r union all select 'default', * from (values {", ".join(f"({quoted(k)}, {quoted(label)}, {quoted(p)})" for k, of in DEFAULT.items() for label, ps in of.items() for p in ps)}) as t(kind, label, pattern)""")
def pack_rules(spark, sf_dir):
    """The rules of all packs, as rows."""
    return profiles(spark, sf_dir).drop("ord")
