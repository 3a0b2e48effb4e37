"""Filter interaction audit by a mask histogram, in DataFrame functions only.

Every document gets five bits, one for each filter that it fails. The counts of the 32 masks of each
part, with what of them is labelled good or toxic, are all that any order of the filters needs: what
a step removes are the masks with its bit and none of the filters before it. So the documents are
read once, and the 120 orders are worked out from 32 cells a part. A filter is first among the k
filters that a document fails in 120 / k of all orders, which gives its Shapley share.

The text groupBy that finds the smallest doc_id of equal texts shuffles the texts' SHA-256, not the
texts. Texts that many documents have are joined without moving them.

Cases: null text is empty, and empty text fails A and E at most; null lang is the empty part. A null
doc_id comes before no other: it never fails E and never makes another fail; rows that repeat a
doc_id don't make each other fail. Labels that repeat count once, a 1 before a 0; null labels are
none. Very long texts are read whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import skew_join, stored

FILTERS = "ABCDE"
BLANKS = " \t\n\x0b\f\r"
CELLS = 1 << len(FILTERS)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, mask of what it fails of A to D."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \x09-\x0D]+")).alias("words"))
    n = F.size("words")
    fails = [n < 100, 100 * F.size(F.array_distinct("words")) < 80 * n, 100 * F.regexp_count("text", F.lit("[A-Z]")) > 10 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    return own.select("doc_id", "part", F.sha2("text", 256).alias("digest"), sum(F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)).alias("mask"))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every document, all five filters."""
    rows = stored(masks(docs), "masks")
    shared = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("cnt")).filter("cnt > 1"), "shared")
    seen = skew_join(rows, shared, ["digest"], rows.count(), "left")
    return seen.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and n, good, toxic: how many documents have each mask, an array of CELLS counts each."""
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    failed = stored(failures(docs), "failures")
    named = failed.filter("doc_id is not null").join(said, "doc_id", "left")
    nameless = failed.filter("doc_id is null").select("doc_id", "part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    counts = named.unionByName(nameless).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    held = counts.groupBy("part").agg(by_mask.alias("cell"))
    every = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def counted(c: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.try_element_at("cell", m)[c], F.lit(0)))

    return held.select("part", *(counted(c).alias(c) for c in ("n", "good", "toxic")))


def _sum(counts: str, where) -> Column:
    """The counts of the masks for which where() holds."""
    return F.aggregate(F.transform(counts, lambda v, m: F.when(where(m), v).otherwise(0)), F.lit(0).cast("long"), lambda a, v: a + v)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, filter_order and step; see the module for what it counts."""
    steps = [(order, k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for p in permutations(FILTERS) for order in ["".join(p)] for k in range(len(order))]
    every = F.expr("array(" + ",".join(f"named_struct('filter_order','{o}','step',{k},'bit',{b},'before',{s})" for o, k, b, s in steps) + ")")
    at = cells(docs, labels).select("part", "n", "good", "toxic", F.explode(every).alias("at")).select("part", "n", "good", "toxic", "at.*")
    bit, before = F.col("bit"), F.col("before")
    has, clean = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) == 0)
    orders = len(steps) // len(FILTERS)
    return at.select(
        "part",
        "filter_order",
        "step",
        _sum("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        _sum("n", lambda m: has(m) & clean(m)).alias("removed"),
        _sum("n", lambda m: has(m) & ~clean(m)).alias("redundant"),
        _sum("n", lambda m: m == bit).alias("unique_fails"),
        _sum("good", lambda m: has(m) & clean(m)).alias("good_lost"),
        _sum("toxic", lambda m: has(m) & clean(m)).alias("toxic_lost"),
        F.aggregate(F.transform("n", lambda v, m: F.when(has(m), v * F.floor(F.lit(orders) / F.bit_count(m))).otherwise(0)), F.lit(0).cast("long"), lambda a, v: a + v).alias("shapley"),
    )
