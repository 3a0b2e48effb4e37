"""Readers with explicit schemas: site documents, seeds, rule files, logs and tab-separated targets.

Paths are opened by Spark, so any store works; small settings (YAML, JSON) come to the driver whole.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = """domain string, url string, company_name string, category array<string>, tier int, crawl_start string, snapshot_date string, total_word_count int,
 pages array<struct<url:string,title:string,h1:string,page_type:string,full_text:string,main_content:string,word_count:int,term_counts:map<string,int>,error:string>>"""
LOG = "timestamp string, domains array<string>, duration_sec double, pages bigint, success int, failed int, methods map<string,int>"
SEED = "carriers array<struct<name:string,domain:string,category:array<string>,tier:int>>"
FLOW = "domain string, recorded string, total_duration_sec double, actions array<struct<action:string,timestamp:double,url:string,selector:string,x:double,y:double,text:string>>"


def sites(spark: SparkSession, path: str) -> DataFrame:
    """Site documents, one a file; files named *summary* are left out, broken ones give null rows that are dropped."""
    found = spark.read.schema(SITE + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = found.select("*", F.col("_metadata.file_name").alias("file"))
    return named.filter(~F.contains("file", F.lit("summary")) & F.col("domain").isNotNull()).drop("_corrupt")


def site_of(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds with their site: by file name of the domain, else the first file that begins with the domain's first label.

    The beginnings of file names are rows of their own, so that both sides meet by equality; only names are compared.
    """
    names = found.select("file").distinct()
    begins = names.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.length("file")), lambda n: F.substring(F.col("file"), F.lit(1), n))).alias("_label"))
    wanted = F.concat(F.regexp_replace("domain", "[./]", "_"), F.lit(".json"))
    near = seeds.select("domain").distinct().withColumn("_label", F.substring_index("domain", ".", 1)).join(begins, "_label")
    best = near.groupBy("domain").agg(F.min_by("file", F.struct(F.col("file") != wanted, "file")).alias("file"))
    held = best.join(found.select("file", F.struct(*[c for c in found.columns if c != "file"]).alias("site")), "file").drop("file")
    return seeds.join(held, "domain", "left")


def pages_of(found: DataFrame) -> DataFrame:
    """One row a page of every site, with the site's columns."""
    return found.select("domain", "company_name", "category", "tier", F.posexplode("pages").alias("pos", "p")).select("domain", "company_name", "category", "tier", "pos", "p.*")


def main_text(page: Column) -> Column:
    return F.coalesce(page["main_content"], page["full_text"], F.lit(""))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED).option("multiLine", True).json(path).select(F.explode("carriers").alias("c")).select("c.*")


def _text(spark: SparkSession, path: str) -> str:
    """A small settings file, whole; a missing one raises."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML settings file; an empty one is {}. Needs PyYAML for .yaml and .yml."""
    raw = _text(spark, path)
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(raw) or {}
    return json.loads(raw) if raw.strip() else {}


@dataclass
class Profile:
    """Rule packs and limits of a crawl, as the operators take them."""

    name: str = "default"
    priorities: dict[str, list[str]] = field(default_factory=dict)
    sections: list[str] = field(default_factory=list)
    products: list[tuple[str, list[str], list[str]]] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    max_depth: int = 2
    max_pages: int = 100
    prioritize_nav: bool = True
    skip_external: bool = True


def _patterns(listed: list | None) -> list[str]:
    """Patterns; one that is none is taken as the text it is."""
    out = []
    for p in listed or []:
        try:
            re.compile(p)
        except re.error:
            p = re.escape(p)
        out.append(p.lower() if p.islower() else p)
    return out


def profile_of(held: dict, name: str = "default") -> Profile:
    """A profile from its settings; what they leave out has its usual value."""
    ranked, limits = held.get("priority") or {}, held.get("settings") or {}
    known = {k: limits[k] for k in ("max_depth", "max_pages", "prioritize_nav", "skip_external") if k in limits}
    products = [(p.get("name", "Unknown"), _patterns(p.get("patterns")), list(p.get("terms") or [])) for p in held.get("products") or [] if isinstance(p, dict)]
    return Profile(held.get("name", name), {k: _patterns(ranked.get(k)) for k in ("high", "medium", "low") if ranked.get(k)}, list(held.get("expected_nav_sections") or []), products, list(held.get("features_of_interest") or []), list(held.get("industry_terms") or []), **known)


def _profile_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name to file of the profiles in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml,json}").load(folder).select("path")
    return {r[0].rsplit("/", 1)[-1].rsplit(".", 1)[0]: r[0] for r in found.collect()}


def profile_names(spark: SparkSession, folder: str) -> list[str]:
    return sorted(_profile_files(spark, folder))


def profile(spark: SparkSession, folder: str, name: str, fallback: str = "generic") -> Profile:
    """A named profile, else the fallback, else one with usual values."""
    files = _profile_files(spark, folder)
    path = files.get(name) or files.get(fallback)
    return profile_of(settings(spark, path), name) if path else Profile()


FIXTURE = "domain string, total_word_count int, access struct<strategy:string,blocked:boolean,escalations:array<string>,block_signals:array<string>>, pages array<struct<url:string,title:string>>"
EXPECTED = "success boolean, blocked boolean, strategy string, pages_gt int, words_gt int, words_lt int, escalations array<string>, block_reason string"


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """id, expected, crawl: the recorded crawls that a folder's manifest.json lists, with what is expected of each; a lost file gives a null crawl."""
    listed = spark.read.schema(f"fixtures array<struct<id:string,crawl_file:string,expected:struct<{EXPECTED.replace(' boolean', ':boolean').replace(' string', ':string').replace(' int', ':int').replace(' array', ':array').replace(', ', ',')}>>>").option("multiLine", True).json(f"{folder}/manifest.json")
    wanted = listed.select(F.explode("fixtures").alias("f")).select("f.*")
    found = spark.read.schema(FIXTURE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    crawls = found.select(F.col("_metadata.file_name").alias("crawl_file"), F.struct(*found.columns).alias("crawl"))
    return wanted.join(crawls, "crawl_file", "left").select("id", "expected", "crawl")


def fixture_failures(held: DataFrame) -> DataFrame:
    """id, failures: what a recorded crawl doesn't meet; what isn't expected isn't checked."""
    e, c = (lambda k, p=p: F.col(f"{p}.{k}") for p in ("expected", "crawl"))
    pages, words, access = F.coalesce(F.size(c("pages")), F.lit(0)), F.coalesce(c("total_word_count"), F.lit(0)), lambda k: F.col(f"crawl.access.{k}")
    pages = F.greatest(pages, F.lit(0))
    checks = {
        "success": (e("success") != ((pages > 0) & (words >= 100))),
        "blocked": e("blocked") != F.coalesce(access("blocked"), F.lit(False)),
        "strategy": e("strategy") != F.coalesce(access("strategy"), F.lit("unknown")),
        "pages_gt": pages <= e("pages_gt"),
        "words_gt": words <= e("words_gt"),
        "words_lt": words >= e("words_lt"),
        "escalations": F.size(F.array_except(e("escalations"), F.coalesce(access("escalations"), F.array().cast("array<string>")))) > 0,
        "block_reason": ~F.contains(F.coalesce(access("block_signals").cast("string"), F.lit("")), e("block_reason")),
    }
    return held.select("id", F.filter(F.array(*(F.when(cond, name) for name, cond in checks.items())), lambda x: x.isNotNull()).alias("failures"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """value: a settings file as one text; many files are many rows."""
    return spark.read.text(path, wholetext=True)


COMPANY = "array<struct<name:string,domain:string,category:string,tier:int>>"


def companies(spark: SparkSession, path: str) -> DataFrame:
    """A list of companies, bare or under `carriers`; anything else is an error. A category may be one name or a list."""
    text = F.col("value")
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, COMPANY)).otherwise(F.from_json(text, f"struct<carriers:{COMPANY}>")["carriers"])
    held = _whole(spark, path).select(listed.alias("c"))
    if held.filter("c is null").count():
        raise ValueError(f"{path}: neither a list nor one under carriers")
    c = F.col("c.category")
    names = F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))
    return held.select(F.explode("c").alias("c")).select("c.name", "c.domain", names.alias("category"), "c.tier")


def playbooks(spark: SparkSession, path: str) -> DataFrame:
    """domain, max_strategy, settings (JSON): entries that aren't mappings are dropped."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("domain", "settings")).filter(F.ltrim("settings").startswith("{"))
    return rows.select("domain", F.get_json_object("settings", "$.max_strategy").alias("max_strategy"), "settings")


def logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed lines are dropped."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path)


def flows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLOW).option("multiLine", True).json(path)


def targets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """idx, timestamp, url, user, post of tab-separated rows whose address is a post; the first `limit` in order of idx."""
    rows = spark.read.schema("idx int, timestamp string, url string").option("sep", "\t").option("header", True).csv(path)
    pattern = r"x\.com/(\w+)/status/(\d+)"
    found = rows.filter(F.col("url").rlike(pattern)).select("idx", "timestamp", "url", F.regexp_extract("url", pattern, 1).alias("user"), F.regexp_extract("url", pattern, 2).alias("post"))
    return found.orderBy("idx").limit(limit) if limit else found


def look(table: DataFrame, columns: list[str], search: str | None = None, head: int | None = None, tail: int | None = None, order: str = "idx") -> DataFrame:
    """Projection, case-insensitive search over the tab-joined row, and the first or last rows."""
    out = table
    if search:
        out = out.filter(F.contains(F.lower(F.concat_ws("\t", *[F.col(c).cast("string") for c in table.columns])), F.lit(search.lower())))
    if head:
        out = out.orderBy(order).limit(head)
    if tail:
        out = out.orderBy(F.desc(order)).limit(tail).orderBy(order)
    return out.select(*columns)
