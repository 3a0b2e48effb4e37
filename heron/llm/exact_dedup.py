"""Exact dedup by deterministic block naming.

Each text is folded (A-Z lower-cased) and cut into blocks of BLOCK bytes. Distinct blocks are
sorted and numbered, so that equal blocks, and only those, share an integer. Adjacent pairs of
integers are then named the same way, level by level, until every document has one integer; with
its number of blocks it identifies the text without collisions. The integers hold within one run;
no result depends on which they are.

A 64-bit fingerprint routes a block to its name. A block whose fingerprint occurs once is like no
other, so its content isn't moved. Blocks of repeated fingerprints are grouped by content; where one
fingerprint turns out to hold several contents, those rows are joined by content instead.

Cases: null text counts as empty; empty texts are equal to each other. Very long texts are many
blocks, each a row. Rows that repeat both doc_id and text count singly in group_size, and one of
them is kept. A null doc_id loses to any other; a group with only null ids keeps one row with
keep_id null. An empty table gives no rows. Extra input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import lower_ascii, skew_join, stored

BLOCK = 4096
NONE = -1
#: Repeated fingerprints (8 bytes) and dropped rows (id and digest) are broadcast up to so many, and joined by shuffle beyond.
FEW_PRINTS, FEW_ROWS = 2_000_000, 500_000
#: Repeated rows are written out so many at a time.
ROWS = 100_000


def _folded() -> Column:
    return lower_ascii(F.coalesce(F.col("text"), F.lit("")))


def _blocks(folded: Column, size: int) -> Column:
    """Array of binary blocks; a lambda argument holds the bytes so that they are made once."""
    cut = lambda b: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(b) / size) - 1, F.lit(0)).cast("int")),
        lambda i: F.substring(b, i * size + 1, F.lit(size)),
    )
    return F.transform(F.array(F.encode(folded, "UTF-8")), cut)[0]


def _numbered(counts: DataFrame, order: list[str]) -> DataFrame:
    """counts with name: distinct values sorted and numbered; stored, as the numbers depend on the partitions."""
    return stored(counts.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()), "names")


def _within(blocks: DataFrame, prints: DataFrame, total: int) -> DataFrame:
    """The blocks whose fingerprint is in prints (fp, cnt)."""
    if prints.count() <= FEW_PRINTS:
        return blocks.join(F.broadcast(prints.select("fp")), "fp", "left_semi")
    return skew_join(blocks, prints, ["fp"], total).drop("cnt")


def _block_names(docs: DataFrame, rows: DataFrame, total: int, size: int, fingerprint) -> DataFrame:
    """rows (doc_id, text_sha256, n, i, fp) with the integer name of each block."""
    counts = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("cnt"))
    names = _numbered(counts, ["fp"])
    repeated = names.filter("cnt > 1").select("fp", "cnt")
    blocks = docs.select(F.explode(_blocks(_folded(), size)).alias("block")).select(fingerprint(F.col("block")).alias("fp"), "block")
    contents = _within(blocks, repeated, total).groupBy("fp", "block").agg(F.count(F.lit(1)).alias("cnt"))
    several = stored(contents.groupBy("fp").agg(F.count(F.lit(1)).alias("contents"), F.sum("cnt").alias("cnt")).filter("contents > 1").drop("contents"), "several")
    if several.isEmpty():
        return skew_join(rows, names, ["fp"], total).drop("fp", "cnt")
    single = skew_join(rows.join(several, "fp", "left_anti"), stored(names.join(several, "fp", "left_anti"), "single"), ["fp"], total)
    spelt = docs.select("doc_id", F.sha2(_folded(), 256).alias("text_sha256"), _blocks(_folded(), size).alias("b")).select("doc_id", "text_sha256", F.size("b").alias("n"), F.posexplode("b").alias("i", "block"))
    spelt = _within(spelt.withColumn("fp", fingerprint(F.col("block"))), several, total)
    named = stored(_within(blocks, several, total).groupBy("fp", "block").agg(F.count(F.lit(1)).alias("cnt")).sortWithinPartitions("block").withColumn("name", -2 - F.monotonically_increasing_id()), "contents")
    return single.drop("fp", "cnt").unionByName(skew_join(spelt, named, ["fp", "block"], total).drop("fp", "block", "cnt"))


def name_documents(docs: DataFrame, block: int = BLOCK, fingerprint=F.xxhash64) -> DataFrame:
    """doc_id, text_sha256, n (blocks), name, copies: one row for each distinct pair of id and text."""
    keyed = stored(docs.select("doc_id", F.sha2(_folded(), 256).alias("text_sha256"), F.transform(_blocks(_folded(), block), lambda b: fingerprint(b)).alias("fps")), "blocks")
    total, largest = keyed.agg(F.sum(F.size("fps")), F.max(F.size("fps"))).first()
    rows = keyed.select("doc_id", "text_sha256", F.size("fps").alias("n"), F.posexplode("fps").alias("i", "fp"))
    at = _block_names(docs, rows, total or 0, block, fingerprint).withColumn("copies", F.lit(1).cast("long"))
    whole = at.filter("n = 1").drop("i")
    for level in range(math.ceil(math.log2(largest or 1))):
        pairs = stored(
            at.filter(F.col("n") > 2**level).groupBy("doc_id", "text_sha256", "n", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(NONE).cast("long")).alias("b"),
                F.sum(F.when(F.col("i") % 2 == 0, F.col("copies"))).alias("copies"),
            ),
            "pairs",
        )
        counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("cnt"))
        at = skew_join(pairs, _numbered(counts, ["a", "b"]), ["a", "b"], pairs.count()).drop("a", "b", "cnt")
        whole = whole.unionByName(at.filter(F.col("n") <= 2 ** (level + 1)).drop("i"))
    return stored(whole.groupBy("doc_id", "text_sha256", "n", "name").agg(F.sum("copies").alias("copies")), "identities")


def _judged(docs: DataFrame, block: int = BLOCK, fingerprint=F.xxhash64) -> DataFrame:
    """doc_id, text_sha256, copies, keep_id, group_size of each distinct pair of id and text."""
    named = name_documents(docs, block, fingerprint)
    groups = stored(named.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("cnt")), "groups")
    return skew_join(named, groups, ["n", "name"], named.count()).drop("n", "name", "cnt")


def exact_dedup(docs: DataFrame, block: int = BLOCK, fingerprint=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: the largest doc_id of equal texts stays."""
    parts = _judged(docs, block, fingerprint).select("*", F.explode(F.expr(f"sequence(0, (copies - 1) div {ROWS})")).alias("part"))
    rows = parts.select("*", F.explode(F.expr(f"sequence(part * {ROWS}, least(copies, (part + 1) * {ROWS}) - 1)")).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; what moves are ids and digests of dropped and of repeated rows."""
    judged = _judged(docs).select(F.col("doc_id").alias("_heron_id"), F.col("text_sha256").alias("_heron_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"), "copies")
    marked = stored(judged.filter("not stays or copies > 1"), "marked")
    gone, repeated = (marked.filter(c).select("_heron_id", "_heron_sha") for c in ("not stays", "stays"))
    ours = docs.withColumn("_heron_mine", F.sha2(_folded(), 256))
    same = F.col("doc_id").eqNullSafe(F.col("_heron_id")) & (F.col("_heron_mine") == F.col("_heron_sha"))
    small = marked.count() <= FEW_ROWS
    held = lambda df: F.broadcast(df) if small else df
    left = ours.join(held(gone), same, "left_anti")
    if repeated.isEmpty():
        return left.drop("_heron_mine")
    once = left.join(held(repeated), same, "left_semi").dropDuplicates(["doc_id", "_heron_mine"])
    return left.join(held(repeated), same, "left_anti").unionByName(once).drop("_heron_mine")
