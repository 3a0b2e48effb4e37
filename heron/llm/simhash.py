"""SimHash near-dedup by exact comparison of all fingerprints, tile by tile.

A fingerprint has the bits that are set in over half of the XXH64 hashes of a text's WIDTH-word
shingles. Documents of equal fingerprints are one node. A fingerprint is cut into slices and lies in
the tile named by its slices' population counts: two fingerprints differ in at least as many bits as
their slices' counts do together, so only tile pairs within RADIUS are compared, by exclusive-or and
bit counts in numpy; all others are skipped. More slices skip more tiles and copy each fingerprint
to more of them; `slices` takes the number with the least work. A tile is dealt over chunks of about
CHUNK fingerprints, so that no pair of chunks is large. Of each pair of chunks comes a forest of its
links, at most one link for each fingerprint, and the forests are joined into components.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts under
WIDTH words are one shingle; very long texts are hashed in pieces, whole. Rows that repeat doc_id
count each. A null doc_id is linked like any other but names no component: where all of a component
are null, so is component_id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from math import comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import pieces, skew_join, stored
from heron.llm.components import components
from heron.session import ship

WIDTH, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a chunk, about.
CHUNK = 1024
#: Most slices, and what it costs to compare two fingerprints and to copy one to a tile, in nanoseconds.
MOST_SLICES, COMPARE_NS, COPY_NS = 8, 3, 80
#: Bytes of a text whose words are hashed at a time.
PIECE = 1 << 20
#: One digit of a tile's name: more than a count and RADIUS.
DIGIT = 128

_BLANK = re.compile(rb"[ \t-\r]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each WIDTH words in a row, or of all where there are fewer."""
    text = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(b" " + text + b" ", np.uint8) == 32)
    width = min(WIDTH, len(words))
    starts, ends = gaps[: len(words) - width + 1].tolist(), (gaps[width:] - 1).tolist()
    return np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8."""
    counts, n, carry, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE)  # a piece ends at a blank
        to = blank.start() if blank else len(text)
        words = carry + text[at:to].translate(_LOWER).split()
        at = to
        if len(words) < WIDTH and at < len(text):
            carry = words
            continue
        if words and (len(words) >= WIDTH or not n):
            h = _hashes(words)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        carry = words[-(WIDTH - 1) :]
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = np.array([fingerprint((t.as_py() or "").encode()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _offsets(n: int) -> list[tuple[int, ...]]:
    """Differences of two tiles' counts that a link may have."""
    return [d for d in product(range(-RADIUS, RADIUS + 1), repeat=n) if sum(map(abs, d)) <= RADIUS]


def slices(nodes: int) -> int:
    """The number of slices with the least work for so many fingerprints, if their bits are even and independent."""

    def work(n: int) -> float:
        ball = sum(2**k * comb(n, k) * comb(RADIUS, k) for k in range(RADIUS + 1))
        spread = sqrt(pi * 64 / n)  # of the difference of two counts: sqrt(2 pi) times sqrt(2 * width / 4)
        return min(1.0, ball / spread**n) * nodes / 2 * COMPARE_NS + ball / 2 * COPY_NS

    return min(range(1, MOST_SLICES + 1), key=work)


def _tile(n: int) -> Column:
    """The name of a fingerprint's tile."""
    name, bounds = F.lit(0).cast("long"), [64 * k // n for k in range(n + 1)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        mask = ((1 << b) - (1 << a)) & (2**64 - 1)
        name = name * DIGIT + F.bit_count(F.col("fp").bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask)))
    return name


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest place reachable) after the links i, j are added."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not ((up := label[label]) == label).all():
            label = up


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what x and y link, one for each fingerprint at most."""
    both = np.concatenate([x, y])
    label = np.arange(len(both))
    step = max(1, (CHUNK * 64) // max(1, len(y)))
    for k in range(0, len(x), step):
        near = np.bitwise_count(x[k : k + step, None] ^ y[None, :]) <= RADIUS
        if near.any():
            i, j = np.nonzero(near)
            label = _connect(label, i + k, j + len(x))
    linked = np.flatnonzero(both != both[label])
    return both[linked], both[label[linked]]


def links(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp of nodes, a forest for each pair of chunks; stored. n: slices."""
    total = nodes.count()
    n = n or slices(total)
    named = stored(nodes.select("fp", _tile(n).alias("tile")), "tiled")
    sizes = stored(named.groupBy("tile").agg(F.count(F.lit(1)).alias("cnt")), "tiles")
    dealt = skew_join(named, sizes, ["tile"], total).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.ceil(F.col("cnt") / CHUNK)).cast("int"))
    chunks = stored(dealt.groupBy("tile", "chunk").agg(F.collect_list("fp").alias("fps")), "chunks")
    packed = sorted(p for d in _offsets(n) if (p := sum(x * DIGIT**k for k, x in enumerate(d))) >= 0)
    index = chunks.select("tile", "chunk")
    left = index.select(F.col("tile").alias("tile_a"), F.col("chunk").alias("chunk_a"), F.explode(F.lit(packed)).alias("by")).withColumn("tile_b", F.col("tile_a") + F.col("by"))
    pairs = left.join(index.select(F.col("tile").alias("tile_b"), F.col("chunk").alias("chunk_b")), "tile_b").filter("by > 0 or chunk_a <= chunk_b").drop("by")
    for side in "ab":
        pairs = pairs.join(chunks.select(F.col("tile").alias(f"tile_{side}"), F.col("chunk").alias(f"chunk_{side}"), F.col("fps").alias(f"fps_{side}")), [f"tile_{side}", f"chunk_{side}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_forest(*(c.values.to_numpy().view(np.uint64) for c in row)) for row in zip(batch.column(0), batch.column(1), strict=True)]
            a, b = (np.concatenate([np.zeros(0, np.uint64), *(f[k] for f in found)]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return stored(pairs.select("fps_a", "fps_b").mapInArrow(run, "a long, b long").distinct(), "links")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: one row a document."""
    prints = stored(fingerprints(docs), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("cnt")), "nodes")
    comps = components(links(nodes)).withColumnRenamed("doc", "fp")
    of_node = stored(nodes.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "of_node")
    lowest = stored(of_node.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("cnt")), "lowest")
    found = stored(skew_join(of_node.select("fp", "comp", F.col("cnt").alias("copies")), lowest, ["comp"], of_node.count()).select("fp", "component_id", F.col("copies").alias("cnt")), "found")
    return skew_join(prints, found, ["fp"], prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
