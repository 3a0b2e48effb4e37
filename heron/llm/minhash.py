"""MinHash near-dedup by a signature-coordinate inverted join.

Every document becomes its set of WIDTH-word shingles and a signature of COORDS minima. Documents
with equal sets are first folded into one node. Each node is posted under its coordinate values; two
sets of similarity 0.75 agree in fewer than AGREE of COORDS coordinates with probability 2e-8. A
pair that agrees in AGREE of them shares one of its COORDS - AGREE + 1 rarest values (both sides
order values alike), so only these prefixes are posted and the longest lists are skipped. Each list
has a centre, its most widely shared member, and lists of one centre are one group. Every member is
first paired with the centre; pairs that agree often enough are confirmed on the full shingle sets
and joined into components. In groups whose members still lie in several components, what can't hold
a link is told by the distances of one set of each component and their radii; of the rest, all
outside the largest component are compared with all members, in squares of bounded size and on full
sets, and one link for each two components comes out. So a group that holds together costs one pair
for each member, and no pair that isn't a link is ever a row; a group that falls apart costs the
square of the number of its components, and of what lies outside the largest within reach of others.

Shingles are compared by 64-bit hashes of their words; words over 64 bytes are hashed by BLAKE2.

Cases: null, empty and blank texts have no set, are linked with nothing and stay. Texts under WIDTH
words are one shingle; very long texts are hashed whole. A document is a row: several texts under
one doc_id are linked each by its own set, and rows that repeat doc_id and text get equal results. A
null doc_id is kept, in a component of its own, without links. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import HEAVY_PARTS, pieces, skew_join, stored
from heron.llm.components import components
from heron.llm.textcodec import U, mix, shingle_sets
from heron.session import ship

WIDTH, COORDS, AGREE = 5, 64, 28
#: Jaccard distance of a link at most.
FAR = 0.25
#: Members, and shingles, of either side that are compared at once where a group has several components.
SQUARE, SQUARE_SHINGLES = 512, 1 << 20
#: Ids of candidate documents (24 bytes each) are broadcast up to this many, and joined by shuffle beyond.
FEW_IDS = 1_000_000
#: Rows of one key that are joined in one task at least before they are salted.
SALT_ROWS = 1000

_ODD = mix(np.arange(1, COORDS + 1, dtype=U)) | U(1)


def _signature(s: np.ndarray) -> np.ndarray:
    out = np.empty(COORDS, U)
    for k in range(COORDS):
        out[k] = (s * _ODD[k]).min()
    return mix(out + np.arange(COORDS, dtype=U))


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, f1, f2 (fingerprint of the set), sig; sig is null for an empty set."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n, f1, f2, sigs = [], [], [], []
            for _, s in shingle_sets(batch.column(1), WIDTH):
                n.append(len(s))
                f1.append(int(mix(s).sum(dtype=U).astype(np.int64)) if len(s) else 0)
                f2.append(int(mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U).astype(np.int64)) if len(s) else 0)
                sigs.append(_signature(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n long, f1 long, f2 long, sig array<long>")


def shingles(texts: DataFrame) -> DataFrame:
    """node, s (the sorted shingle hashes) of texts (node, text)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            ids, held, size = [], [], 0
            for row, s in shingle_sets(batch.column(1), WIDTH):
                ids.append(batch.column(0)[row].as_py())
                held.append(s.view(np.int64))
                size += len(s)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["node", "s"])
                    ids, held, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["node", "s"])

    return texts.select("node", "text").mapInArrow(run, "node long, s array<long>")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """token, node: the postings that can bring two nodes together; stored."""
    postings = nodes.select("node", F.explode("sig").alias("token"))
    freq = stored(postings.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1"), "freq")
    total = nodes.count() * COORDS
    shared = skew_join(postings, freq, ["token"], total)
    ranked = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("cnt", "token"))).alias("t"))
    room = F.lit(COORDS - AGREE + 1) - (F.lit(COORDS) - F.size("t"))  # values held by no other node come first
    return stored(ranked.filter(F.size("t") >= AGREE).select("node", F.explode(F.slice("t", F.lit(1), room)).alias("p")).select("node", "p.token"), "prefix")


def _attached(pairs: DataFrame, rows: DataFrame, key: str, other: str, **columns: str) -> DataFrame:
    """pairs with columns of the row whose node is key.

    Keys of very many pairs are salted by `other`: their row is copied once for each salt, and only
    the salts of fewer than HEAVY_PARTS keys are broadcast, never the columns.
    """
    right = rows.select(F.col("node").alias(key), *(F.col(c).alias(to) for c, to in columns.items()))
    per = max(pairs.count() // HEAVY_PARTS, SALT_ROWS)
    salts = stored(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > per).select(key, F.ceil(F.col("cnt") / per).cast("int").alias("salts")), "salts")
    if salts.isEmpty():
        return pairs.join(right, key)
    dealt = lambda df: df.join(F.broadcast(salts), key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = dealt(pairs).withColumn("salt", F.pmod(F.xxhash64(other), F.col("salts")).cast("int")).drop("salts")
    copied = dealt(right).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.join(copied, [key, "salt"]).drop("salt")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in AGREE coordinates and whose set sizes allow a link; stored."""
    pairs = stored(pairs, "stars")
    both = _attached(_attached(pairs, nodes, "b", "a", n="n_b", sig="s_b"), nodes, "a", "b", n="n_a", sig="s_a")
    same = F.expr("aggregate(zip_with(s_a, s_b, (x, y) -> if(x = y, 1, 0)), 0, (x, y) -> x + y)")
    return stored(both.filter((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * 75) & (same >= AGREE)).select("a", "b"), "pairs")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The stored pairs whose full shingle sets meet 100 * |intersection| >= 75 * |union|; stored."""
    sets = _sets(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    joined = _attached(_attached(pairs, sets, "b", "a", s="s_b"), sets, "a", "b", s="s_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stored(joined.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long"), "links")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, s: the shingle set of each node in wanted, from the text that stands for it; stored."""
    ids = stored(nodes.select("node", F.col("doc_id").alias("_heron_id"), F.col("text_key").alias("_heron_key")).join(wanted, "node", "left_semi"), "ids")
    ours = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    held = ours.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, F.expr("doc_id = _heron_id and text_key = _heron_key"))
    # rows that repeat id and text make one set
    return stored(shingles(held).groupBy("node").agg(F.first("s").alias("s")), "sets")


def _shared(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of side 0, rows of side 1, sizes of all sets, and how many shingles each two sets of the sides share."""
    side = part.column("side").to_numpy()
    sets = part.column("s").combine_chunks()
    at, values = sets.offsets.to_numpy() - sets.offsets[0].as_py(), sets.flatten().to_numpy()
    size = np.diff(at)
    row = np.repeat(np.arange(len(side)), size)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    inx = side[row] == 0
    vocabulary = np.intersect1d(values[inx], values[~inx])
    both = np.zeros((len(x), len(y)), np.float32)
    place = np.empty(len(side), np.int64)
    place[x], place[y] = np.arange(len(x)), np.arange(len(y))
    column = np.searchsorted(vocabulary, values)
    known = column < len(vocabulary)
    known[known] = vocabulary[column[known]] == values[known]
    row, column, inx = row[known], column[known], inx[known]
    order = np.argsort(column, kind="stable")
    row, column, inx = row[order], column[order], inx[order]
    for k in range(0, len(vocabulary), SQUARE * 4):
        lo, hi = np.searchsorted(column, [k, k + SQUARE * 4])
        width = min(SQUARE * 4, len(vocabulary) - k)
        left, right = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        r, c, i = row[lo:hi], column[lo:hi] - k, inx[lo:hi]
        left[place[r[i]], c[i]] = 1
        right[place[r[~i]], c[~i]] = 1
        both += left @ right.T
    return x, y, size, both


def _compare(part: pa.Table) -> pa.Table:
    """One link for each two components that linked sets of the two sides lie in; sets are compared exactly."""
    comp = part.column("comp").to_numpy()
    x, y, size, both = _shared(part)
    linked = (100 * both >= 75 * (size[x][:, None] + size[y][None, :] - both)) & (comp[x][:, None] != comp[y][None, :])
    i, j = np.nonzero(linked)
    found = np.unique(np.sort(np.stack([comp[x[i]], comp[y[j]]], 1), 1), axis=0)
    return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})


def _within_reach(part: pa.Table) -> pa.Table:
    """The components that may hold a link to another one, by the distance of what stands for them and their radius."""
    comp, radius, centre = (part.column(c).to_numpy() for c in ("comp", "radius", "centre"))
    x, y, size, both = _shared(part)
    apart = 1 - both.astype(np.float64) / (size[x][:, None] + size[y][None, :] - both)
    near = (apart <= FAR + radius[x][:, None] + radius[y][None, :] + 1e-9) & (comp[x][:, None] != comp[y][None, :])
    i, j = np.nonzero(near)
    found = np.unique(np.concatenate([comp[x[i]], comp[y[j]]]))
    return pa.table({"centre": pa.array(np.repeat(centre[:1], len(found)), pa.int64()), "comp": pa.array(found, pa.int64())})


def _cells(size: Column, n: Column) -> Column:
    return F.greatest(F.ceil(size / SQUARE), F.ceil(n / SQUARE_SHINGLES)).cast("int")


def _block(doc: str, n: str) -> Column:
    return F.pmod(F.xxhash64(doc), F.col(n)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _split(held: DataFrame) -> DataFrame:
    """The members (centre, node, n, comp) of groups that lie in several components, with the largest one (main), and in how many rows and columns of squares; stored."""
    parts = held.groupBy("centre", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    split = parts.groupBy("centre").agg(F.max(F.struct("size", "comp", "n")).alias("most"), F.sum("size").alias("cnt"), F.sum("n").alias("n")).filter("most.size < cnt")
    split = stored(split.select("centre", F.col("most.comp").alias("main"), "cnt", _cells(F.col("cnt") - F.col("most.size"), F.col("n") - F.col("most.n")).alias("rows"), _cells(F.col("cnt"), F.col("n")).alias("columns")), "split")
    return stored(skew_join(held, split, ["centre"], held.count()), "of_split")


def _reachable(of_split: DataFrame, sets: DataFrame) -> DataFrame:
    """centre, comp, cnt of the components that may hold a link to another one of their group; stored.

    Jaccard distance is a metric: sets of two components can't be linked if the sets that stand for
    the components are further apart than FAR and both components' radii. So each member is compared
    with its component's own set, and these sets with each other, square by square.
    """
    own = stored(of_split.groupBy("centre", "comp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("cnt"), F.sum("n").alias("n")), "reps")
    pairs = skew_join(of_split.select("centre", "comp", F.col("node").alias("b")), own.select("centre", "comp", F.col("rep").alias("a"), "cnt"), ["centre", "comp"], of_split.count()).filter("a <> b")
    pairs = stored(pairs.select("centre", "comp", "a", "b"), "spread")
    joined = _attached(_attached(pairs, sets, "b", "a", s="s_b"), sets, "a", "b", s="s_a").select("centre", "comp", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                apart.append(1 - both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart, pa.float64())], ["centre", "comp", "apart"])

    radius = joined.mapInArrow(run, "centre long, comp long, apart double").groupBy("centre", "comp").agg(F.max("apart").alias("radius"))
    total = own.groupBy("centre").agg(_cells(F.count(F.lit(1)), F.sum("n")).alias("cells"), F.count(F.lit(1)).alias("cnt"))
    stands = own.join(radius, ["centre", "comp"], "left").select("centre", "comp", "rep", F.coalesce("radius", F.lit(0.0)).alias("radius"))
    stands = skew_join(stored(stands, "stands"), stored(total, "total"), ["centre"], own.count()).drop("cnt").join(sets.withColumnRenamed("node", "rep"), "rep")
    left = stands.select("centre", _block("rep", "cells").alias("i"), _each("cells").alias("j"), F.lit(0).alias("side"), "comp", "radius", "s")
    right = stands.select("centre", _each("cells").alias("i"), _block("rep", "cells").alias("j"), F.lit(1).alias("side"), "comp", "radius", "s")
    near = left.unionByName(right).groupBy("centre", "i", "j").applyInArrow(_within_reach, "centre long, comp long").distinct()
    return stored(near.join(own.select("centre", "comp", "cnt"), ["centre", "comp"]), "near")


def _across(member: DataFrame, label: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between members of one group (centre, node) that lie in different components; stored.

    Components out of reach of all others of the group are left out. Of the rest, all members outside
    the largest component are compared with all members, square by square; a square has about SQUARE
    members and SQUARE_SHINGLES shingles on either side.
    """
    held = stored(member.join(label.select(F.col("doc").alias("node"), "comp"), "node", "left").join(nodes.select("node", "n"), "node").select("centre", "node", "n", F.coalesce("comp", "node").alias("comp")), "held")
    of_split = _split(held)
    sets = _sets(docs, nodes, of_split.select("node").distinct())
    near = _reachable(of_split, sets)
    again = stored(skew_join(of_split.select("centre", "node", "n", "comp"), near, ["centre", "comp"], of_split.count()).drop("cnt"), "again")
    full = _split(again).join(sets, "node").withColumnRenamed("node", "doc")
    out = full.filter("comp <> main").select("centre", _block("doc", "rows").alias("i"), _each("columns").alias("j"), F.lit(0).alias("side"), "comp", "s")
    every = full.select("centre", _each("rows").alias("i"), _block("doc", "columns").alias("j"), F.lit(1).alias("side"), "comp", "s")
    return stored(out.unionByName(every).groupBy("centre", "i", "j").applyInArrow(_compare, "a long, b long").distinct(), "across")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    return _judged(docs).drop("text_key")


def _judged(docs: DataFrame) -> DataFrame:
    """near_dedup() with text_key."""
    sigs = stored(signatures(docs), "sigs")
    some = sigs.filter("doc_id is not null and n > 0")
    classes = some.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("m"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("cnt"))
    classes = stored(classes.select("f1", "f2", "n", "m.*", "sig", "cnt", F.monotonically_increasing_id().alias("node")), "classes")
    nodes = classes.select("node", "doc_id", "text_key", "n", "sig")
    prefix = _prefixes(nodes)
    weight = stored(prefix.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1"), "weight")
    heavy = skew_join(prefix, weight, ["token"], prefix.count())
    central = heavy.groupBy("node").agg(F.sum("cnt").alias("w"))
    centred = stored(heavy.select("node", "token").join(central, "node"), "centred")
    centres = stored(centred.groupBy("token").agg(F.min(F.struct(-F.col("w"), "node")).alias("c"), F.count(F.lit(1)).alias("cnt")).select("token", F.col("c.node").alias("centre"), "cnt"), "centres")
    member = stored(skew_join(centred.select("token", "node"), centres, ["token"], centred.count()).select("centre", "node").distinct(), "member")
    stars = member.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    links = _confirmed(_agreeing(stars, nodes), nodes, docs)
    more = _across(member, components(links), nodes, docs)
    if not more.isEmpty():
        links = stored(links.unionByName(more), "all")
    of_node = classes.join(components(links).select(F.col("doc").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_node = stored(of_node.select("f1", "f2", "n", "comp", "doc_id", "cnt"), "of_node")
    lowest = stored(of_node.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("cnt")), "lowest")
    of_class = stored(skew_join(of_node.drop("doc_id").withColumnRenamed("cnt", "copies"), lowest, ["comp"], of_node.count()).select("f1", "f2", "n", "component_id", F.col("copies").alias("cnt")), "of_class")
    linked = skew_join(some.select("doc_id", "text_key", "f1", "f2", "n"), of_class, ["f1", "f2", "n"], some.count()).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")
    alone = sigs.filter("doc_id is null or n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: those of the smallest doc_id of each component."""
    gone = stored(_judged(docs).filter("not kept").select(F.col("doc_id").alias("_heron_id"), F.col("text_key").alias("_heron_key")).distinct(), "gone")
    few = gone.count() <= FEW_IDS  # then only ids move
    return docs.join(F.broadcast(gone) if few else gone, (F.col("doc_id").cast("long") == F.col("_heron_id")) & (text_key() == F.col("_heron_key")), "left_anti")
