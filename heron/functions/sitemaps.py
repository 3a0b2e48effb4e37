"""Site maps that name site maps: all that a map leads to, over a table of maps.

A semi-naive join: each round follows only the maps that the round before found for the first time,
so indexes that name each other, or one map from two sides, end. A round's finds are written to the
shared folder, which also cuts the lineage.

Cases: a map that isn't in the table is reached and lists nothing; null and broken maps list nothing;
several texts of one map count together. Depth 0 gives the roots alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.functions.markup import sitemap_children, sitemap_urls
from heron.session import folder


def reached(maps: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """root, source, depth: the maps (source, xml) that each of roots (source) leads to, and in how many steps at least."""
    spark, place = maps.sparkSession, folder(maps.sparkSession)
    edges = sitemap_children(maps.filter("source is not null and xml is not null")).select("source", F.col("loc").alias("child")).distinct()
    edges.write.parquet(f"{place}/edges")
    edges = spark.read.schema(edges.schema).parquet(f"{place}/edges")

    def written(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{place}/found/depth={n}")
        return spark.read.schema("root string, source string").parquet(f"{place}/found/depth={n}")

    last = written(roots.filter("source is not null").select(F.col("source").alias("root"), "source").distinct(), 0)
    for n in range(1, depth + 1):
        if last.isEmpty():
            break
        seen = spark.read.schema("root string, source string, depth int").parquet(f"{place}/found")
        step = last.join(edges, "source").select("root", F.col("child").alias("source")).distinct()
        last = written(step.join(seen.select("root", "source"), ["root", "source"], "left_anti"), n)
    return spark.read.schema("root string, source string, depth int").parquet(f"{place}/found")


def all_urls(maps: DataFrame, roots: DataFrame, depth: int = 5, most: int = 10000) -> DataFrame:
    """root, loc, depth, lastmod: what the maps of each root list, an address once, by the nearest map; `most` of each map."""
    held = reached(maps, roots, depth)
    urls = sitemap_urls(maps.filter("source is not null and xml is not null"), most).select("source", "loc", "lastmod")
    return held.join(urls, "source").groupBy("root", "loc").agg(F.min("depth").alias("depth"), F.max("lastmod").alias("lastmod"))
