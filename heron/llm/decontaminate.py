"""Benchmark decontamination over a distributed positional inverted index.

Items and documents become words: A-Z folded, runs of characters other than ASCII non-alphanumerics.
The index holds postings (term, document, position) of the corpus for the terms asked for. Each test
window names its rarest terms by corpus frequency, as many as it takes for fewer than CHANCE places
to be expected at random. The rarest term's list, shifted by the term's offset, gives places that
are intersected with the shifted lists of the others. What remains is checked on all terms of the
window, again by shifted lists, now of the candidate documents only.
`phrase_matches` returns exact occurrences, `proximity_matches` pairs of a window's two rarest
terms within a distance.

Cases: null and empty texts have no words and no hits. An item of fewer words than a window is one
window of its own; an item without words is none. Repeated documents and items count like any other
(rows that repeat both doc_id and text give equal rows). An empty benchmark leaves all documents
clean; empty documents give no rows. Null ids are kept and matched like others; a null item_id is
not listed among items. Very long texts are read whole, a posting a term. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.llm.common import lower_ascii, stored

WINDOW = 10
#: Places expected at random in the whole corpus below which a window needs no further list.
CHANCE = 1e-3
#: Distinct test terms or windows are broadcast up to this many rows (about 100 MB), else joined by shuffle.
FEW = 1_000_000
SEPARATORS = r"[\x00-/:-`{-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def document_key() -> tuple[Column, Column]:
    return F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")


def small(df: DataFrame) -> DataFrame:
    """Marks a table for broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def test_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, window (its words as one string), w (the words): each window of each item."""
    w = items.select("item_id", words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (width - 1), F.lit(1)))
    return w.select("item_id", "all", F.explode(starts).alias("s")).select("item_id", F.slice("all", F.col("s"), F.lit(width)).alias("w")).select("item_id", F.array_join("w", " ").alias("window"), "w").distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, text_key, pos: every occurrence of the terms in whole texts."""
    flat = docs.select(*document_key(), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return flat.join(small(terms), "term")


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words of every row; stored."""
    return stored(docs.select(*document_key(), F.size(words(F.col("text"))).cast("long").alias("n_words")), "counts")


def term_windows(docs: DataFrame, windows: DataFrame, n_words: int) -> DataFrame:
    """window, n, term, off, rank (0: rarest in the corpus), whole (the corpus has all terms), needed (an anchor); stored. Terms that the corpus lacks have no rows."""
    spelt = windows.select("window", F.size("w").alias("n"), F.posexplode("w").alias("off", "term")).distinct()
    terms = stored(spelt.select("term").distinct(), "terms")
    freq = stored(postings(docs, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    known = spelt.join(small(freq), "term")
    order = Window.partitionBy("window").orderBy("df", "term", "off")
    whole = F.count(F.lit(1)).over(Window.partitionBy("window")) == F.col("n")
    before = F.coalesce(F.sum(F.log(F.col("df") / F.lit(max(n_words, 1)))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = known.select("window", "n", "term", "off", (F.row_number().over(order) - 1).alias("rank"), whole.alias("whole"), before.alias("before"))
    needed = (F.col("rank") == 0) | (F.log(F.lit(max(n_words, 1))) + F.col("before") > math.log(CHANCE))
    return stored(ranked.select("window", "n", "term", "off", "rank", "whole", needed.alias("needed")), "windows")


def _met(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted (doc_id, text_key, window, n, start, term, off) rows whose term stands at start + off."""
    at = wanted.withColumn("pos", F.col("start") + F.col("off"))
    held = index.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("pos").alias("p"), F.col("term").alias("t")).distinct()
    return at.join(held, F.expr("doc_id <=> d and text_key = k and pos = p and term = t"))


def phrase_matches(docs: DataFrame, windows: DataFrame, n_words: int) -> DataFrame:
    """doc_id, text_key, window, n, start: every exact occurrence; windows has window, w."""
    # a window with a term that the corpus lacks can't occur
    spelt = term_windows(docs, windows, n_words).filter("whole")
    anchors = spelt.filter("needed")
    place = ["doc_id", "text_key", "window", "n", "start"]
    index = stored(postings(docs, stored(anchors.select("term").distinct(), "anchors")).select("term", *place[:2], "pos"), "index")
    first = index.join(small(anchors.filter("rank = 0")), "term").select(*place[:4], (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0").distinct()
    others = stored(anchors.filter("rank > 0").select("window", "term", "off"), "others")
    several = stored(others.groupBy("window").agg(F.count(F.lit(1)).alias("lists")), "several")
    begun = first.join(small(several), "window", "left")
    met = _met(begun.filter("lists is not null").join(small(others), "window"), index).groupBy(*place, "lists").agg(F.count(F.lit(1)).alias("met"))
    candidates = stored(met.filter("met = lists").select(*place).unionByName(begun.filter("lists is null").select(*place)), "candidates")
    some = stored(candidates.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct(), "some")
    held = docs.select("doc_id", "text", document_key()[1]).join(small(some), F.expr("doc_id <=> d and text_key = k"), "left_semi").select("doc_id", "text")
    rest = stored(postings(held, stored(spelt.select("term").distinct(), "terms")), "postings")
    whole = _met(candidates.join(small(spelt.select("window", "term", "off")), "window"), rest)
    return whole.groupBy(*place).agg(F.count(F.lit(1)).alias("met")).filter("met = n").drop("met")


def proximity_matches(docs: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """doc_id, text_key, window, at, apart: places where the two rarest distinct terms of a window that the corpus has stand within slop words."""
    n_words = word_counts(docs).agg(F.sum("n_words")).first()[0] or 0
    held = term_windows(docs, windows, n_words).groupBy("window", "term").agg(F.min("rank").alias("rank"))
    two = held.withColumn("place", F.row_number().over(Window.partitionBy("window").orderBy("rank"))).filter("place < 3")
    pair = stored(two.groupBy("window").agg(F.min_by("term", "place").alias("x"), F.max_by("term", "place").alias("y")).filter("x <> y"), "pairs")
    index = stored(postings(docs, stored(pair.select(F.explode(F.array("x", "y")).alias("term")).distinct(), "anchors")).withColumn("cell", F.floor(F.col("pos") / (slop + 1))), "near")
    left = index.join(small(pair.withColumnRenamed("x", "term")), "term").withColumnRenamed("pos", "at").select("doc_id", "text_key", "window", "at", "y", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    right = index.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("cell").alias("c"), F.col("term").alias("t"), "pos")
    both = left.join(right, F.expr("doc_id <=> d and text_key = k and cell = c and y = t"))
    return both.withColumn("apart", F.abs(F.col("pos") - F.col("at"))).filter(F.col("apart") <= slop).select("doc_id", "text_key", "window", "at", "apart").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated of every document."""
    return _judged(docs, items, width).drop("text_key")


def _judged(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """contamination() with text_key."""
    windows = stored(test_windows(items, width), "windows")
    every = word_counts(docs)
    total = every.agg(F.sum("n_words")).first()[0] or 0
    found = stored(phrase_matches(docs, windows.select("window", "w").distinct(), total), "matches")
    hit = found.select("doc_id", "text_key", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).groupBy("doc_id", "text_key").agg(F.count_distinct("pos").alias("n_hit"))
    named = found.select("doc_id", "text_key", "window").distinct().join(small(windows.select("window", "item_id")), "window")
    listed = named.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    dirty = hit.join(listed.withColumnsRenamed({"doc_id": "d", "text_key": "k"}), F.expr("doc_id <=> d and text_key = k"), "left").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "n_hit", "items")
    dirty = stored(dirty, "dirty")
    joined = every.join(small(dirty), F.expr("doc_id <=> d and text_key = k"), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "text_key", "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns."""
    dirty = stored(_judged(docs, items).filter("contaminated").select(F.col("doc_id").alias("_heron_id"), F.col("text_key").alias("_heron_key")).distinct(), "dirty")
    return docs.join(small(dirty), F.col("doc_id").eqNullSafe(F.col("_heron_id")) & (document_key()[1] == F.col("_heron_key")), "left_anti")
