"""Writers: exports of pages and sites, partitioned site documents, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_jsonl(pages: DataFrame, path: str) -> None:
    """One JSON object a line a page."""
    pages.write.mode("overwrite").json(path)


def export_csv(pages: DataFrame, path: str) -> None:
    """Flat table: titles of a hundred characters, arrays as whether they hold anything."""
    flat = [F.substring(c, 1, 100).alias(c) if c == "title" else (F.size(c) > 0).alias(f"has_{c}") if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("map", "struct")) else F.col(c) for c, t in pages.dtypes]
    pages.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_sites(sites: DataFrame, path: str) -> None:
    """Site documents by base domain."""
    base = F.regexp_replace("domain", r"[./]", "_")
    sites.withColumn("base_domain", base).write.mode("overwrite").partitionBy("base_domain").json(path)


def append_log(run: DataFrame, path: str) -> None:
    run.write.mode("append").json(path)


def _listed(banner: str, items: Column) -> Column:
    """Lines under a banner with a blank one after them; none without items."""
    return F.when(F.size(items) > 0, F.concat(F.array(F.lit(banner)), items, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def _block_lines(b: Column) -> Column:
    content = b["content"]
    heading = F.concat(F.repeat(F.lit("#"), F.least(b["level"] + 2, F.lit(6))), F.lit(" "), content)
    one = F.when(b["type"] == "heading", heading).when(b["type"] == "cta", F.concat(F.lit("**["), content, F.lit("]**"))).when(b["type"] == "image", F.concat(F.lit("[Image: "), content, F.lit("]"))).otherwise(content)
    return F.when(b["type"] == "text", F.array(one, F.lit(""))).otherwise(F.array(one))


def as_text(records: DataFrame) -> DataFrame:
    """page_id, text: page records as readable text; ten quick links, twenty of navigation, thirty of the footer."""
    links = lambda c, most: F.transform(F.slice(c, 1, most), lambda x: F.concat(F.lit("- "), x["text"]))
    said = lambda c, *lines: F.when(F.coalesce(c, F.lit("")) != "", F.array(*lines, F.lit(""))).otherwise(F.array().cast("array<string>"))
    parts = [
        F.array(F.concat(F.lit("# "), F.col("title")), F.lit("")),
        said(F.col("description"), F.concat(F.lit("_"), F.col("description"), F.lit("_"))),
        _listed("## Quick Links", links("utility_nav", 10)),
        _listed("## Navigation", links("primary_nav", 20)),
        said(F.col("hero"), F.lit("## Hero"), F.col("hero")),
        _listed("## Content", F.flatten(F.transform("main", _block_lines))),
        _listed("## Footer", links("footer_links", 30)),
        F.array(F.lit("---"), F.concat(F.lit("Word count: "), F.col("word_count").cast("string"))),
    ]
    return records.select("page_id", F.array_join(F.concat(*parts), "\n").alias("text"))


def as_json(records: DataFrame) -> DataFrame:
    """page_id, json: each record as one JSON document."""
    return records.select("page_id", F.to_json(F.struct(*[c for c in records.columns if c != "page_id"]), {"ignoreNullFields": "false"}).alias("json"))
