"""Robots files derived from the pages' own addresses, and what they allow."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.exprs import Registry, quoted
from heron.functions import robots

R = Registry()
AGENT = "HeronBot/1.0"

#: A file for each domain, by the length of its name: {first} and {last} are its smallest and largest path, {part} the first part of the smallest.
FILES = [
    "User-agent: *\nAllow: {first}\nDisallow: {part}/\n",
    "User-agent: other\nUser-agent: HERONBOT\nDisallow: {last}\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: *\nDisallow: /\n\nUser-agent: heron\nCrawl-delay: 3\nAllow: /en\nDisallow: /%65s/ # Spanish\nDisallow: {first}\n",
    "Disallow: /\nUser-agent: heronbot\n\nDisallow: /\nUser-agent: *\nDisallow:\nDisallow: /\n",
    "User-agent: *\n# the rest is open\nDisallow: {part}/{n}\nAllow: /\n\nUser-agent: *\nDisallow: /\n\nUser-agent: HeronBot/2\nDisallow: /",
]
DOMAIN, PATH = "regexp_extract(url, '^https?://([^/?#]+)', 1)", "regexp_replace(url, '^https?://[^/?#]+', '')"


def addresses(spark, sf_dir):
    """page_id, domain, path of every page."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{DOMAIN} as domain", f"{PATH} as path")


def files(spark, sf_dir):
    """domain, content: a robots file for every domain of the pages."""
    of = addresses(spark, sf_dir).groupBy("domain").agg(F.min("path").alias("first"), F.max("path").alias("last"), (F.count(F.lit(1)) % 10).alias("n"))
    shape = F.element_at(F.array(*map(F.lit, FILES)), F.length("domain") % len(FILES) + 1)
    for name in ("first", "last", "n"):
        shape = F.replace(shape, F.lit(f"{{{name}}}"), F.col(name).cast("string"))
    return of.select("domain", F.replace(shape, F.lit("{part}"), F.regexp_extract("first", "^/[^/]*", 0)).alias("content"))


_SHAPE = "case length(domain) % 5 " + " ".join(f"when {k} then {quoted(t)}" for k, t in enumerate(FILES)) + " end"
_PATHS = "a as (select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as domain, regexp_replace(url, '^https?://[^/?#]+', '') as path from pages)"
SQL_RULES = f"""with {_PATHS},
 f as (select domain, replace(replace(replace(replace({_SHAPE}, '{{first}}', min(path)), '{{last}}', max(path)), '{{n}}', cast(count(*) % 10 as varchar)), '{{part}}', regexp_extract(min(path), '^/[^/]*', 0)) as content from a group by domain),
 l as (select domain, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as pos from f),
 c as (select domain, pos, line, lower(trim(split_part(line, ':', 1))) as said, trim(regexp_replace(regexp_replace(line, '#.*$', ''), '^[^:]*:', '')) as value from l where not starts_with(trim(line), '#')),
 e as (select *, case when line = '' then 'gap' when said = 'user-agent' then 'agent' else 'rule' end as kind from c where line = '' or said in ('user-agent', 'allow', 'disallow', 'crawl-delay')),
 s as (select *, (select max(b.pos) from e b where b.domain = e.domain and b.pos < e.pos and b.kind <> 'agent') as broken, (select arg_max(b.kind, b.pos) from e b where b.domain = e.domain and b.pos <= e.pos and b.kind <> 'rule') as last from e),
 g as (select r.domain, r.pos, r.said, r.value, (select max(u.pos) from s u where u.domain = r.domain and u.kind = 'agent' and u.pos < r.pos) as at from s r where r.kind = 'rule' and r.last = 'agent'),
 n as (select g.domain, g.pos, g.said, g.value, u.broken as part, u.at from g join (select domain, pos as at, coalesce(broken, -1) as broken from s where kind = 'agent') u on u.domain = g.domain and u.at = g.at),
 w as (select n.domain, n.part, max(cast(s.value = '*' as int)) as star, max(cast(contains('heronbot', lower(s.value)) as int)) as ours from (select distinct domain, part from n) n join s on s.domain = n.domain and s.kind = 'agent' and coalesce(s.broken, -1) = n.part group by all),
 h as (select domain, coalesce(min(case when ours = 1 and star = 0 then part end), min(case when star = 1 then part end)) as part from w group by domain),
 rules as (select n.domain, n.pos, n.said = 'allow' or n.value = '' as allow, replace(replace(replace(n.value, '%65', 'e'), '?', '%3F'), '&', '%26') as path from n join h on n.domain = h.domain and n.part = h.part where n.said in ('allow', 'disallow'))"""


@R.add("robots_in_force", f"{SQL_RULES} select domain, cast(pos as int) as pos, allow, replace(replace(path, '=', '%3D'), '#', '%23') as path from rules")
def robots_in_force(spark, sf_dir):
    """The rules of each domain's file that hold for the agent, in order, with their paths as they are compared."""
    return robots.rules(files(spark, sf_dir), AGENT)


@R.add("robots_decisions", f"{SQL_RULES} select page_id, domain, path, coalesce((select arg_min(r.allow, r.pos) from rules r where r.domain = a.domain and starts_with(replace(replace(replace(replace(a.path, '?', '%3F'), '&', '%26'), '=', '%3D'), '#', '%23'), replace(replace(r.path, '=', '%3D'), '#', '%23'))), true) as allowed from a")
def robots_decisions(spark, sf_dir):
    """Whether the agent may fetch each page."""
    return robots.decisions(addresses(spark, sf_dir), files(spark, sf_dir), AGENT)
