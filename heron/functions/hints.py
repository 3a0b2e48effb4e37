"""Where a crawl should look deeper, and why: features that links, else the page's text, speak of.

A feature is (address patterns, text patterns, priority, depth boost), in order. A link names the
feature by its address or by its text; each subtree goes to the first feature and link that name it.
A feature that got no subtree is hinted at by the page's text, without one.

Cases: links without a path name nothing; null addresses and texts match nothing; a page without
links has hints from its text alone; each page of a repeated page_id adds to the same hints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron import rules

Pack = dict[str, tuple[list[str], list[str], str, int]]


def _why(low: Column, shown: Column | None, patterns: list[str], say: str) -> list[Column]:
    return [F.when(low.rlike(p), F.concat(F.lit(say.format(p)), shown) if shown is not None else F.lit(say.format(p))) for p in patterns]


def _told(pack: Pack, reason) -> Column:
    """Array of (rank, reason) of the features that reason(address patterns, text patterns) gives one for."""
    each = [F.struct(F.lit(k).alias("rank"), F.coalesce(*found, F.lit(None).cast("string")).alias("reason")) for k, (urls, texts, _, _) in enumerate(pack.values()) for found in [reason(urls, texts)]]
    return F.filter(F.array(*each), lambda e: e["reason"].isNotNull())


def hints(links: DataFrame, texts: DataFrame, pack: Pack = rules.HINTS) -> DataFrame:
    """page_id, feature, subtree, priority, depth_boost, reason by links (page_id, pos, url, text, path) and texts (page_id, text)."""
    url, text = F.lower("url"), F.lower("text")
    named = _told(pack, lambda u, t: [*_why(url, F.col("url"), u, "URL pattern '{}' matched: "), *_why(text, F.col("text"), t, "Link text matched '{}': ")])
    hit = links.filter("path <> ''").select("page_id", "pos", F.col("path").alias("subtree"), F.explode(named).alias("e"))
    best = hit.groupBy("page_id", "subtree").agg(F.min(F.struct("e.rank", "pos", "e.reason")).alias("b")).select("page_id", "subtree", F.col("b.rank").alias("rank"), F.col("b.reason").alias("reason"))
    said = _told(pack, lambda u, t: _why(text, None, t, "Page text contains '{}'"))
    rest = texts.select("page_id", F.explode(said).alias("e")).select("page_id", F.lit("").alias("subtree"), "e.rank", "e.reason").join(best.select("page_id", "rank"), ["page_id", "rank"], "left_anti")
    about = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(p).alias("priority"), F.lit(b).alias("boost")) for f, (_, _, p, b) in pack.items()))
    both = best.unionByName(rest).withColumn("a", F.get(about, F.col("rank")))
    return both.select("page_id", "a.feature", "subtree", "a.priority", F.when(F.col("subtree") == "", 0).otherwise(F.col("a.boost")).alias("depth_boost"), "reason").distinct()
