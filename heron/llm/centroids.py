"""Centroid clustering of integer vectors, exact, with partial-distance search.

Components are the integers floor(SCALE * x). All sums, means and distances are of integers, so the
result is the same at any number of partitions. In the search a centroid's squared differences are
added over the dimensions of highest variance first, STEP at a time; a vector abandons a centroid
once the sum is strictly above its best so far, and survivors finish all dimensions. A round reads
the stored vectors, sums them up in the task and shuffles a row for each task, centroid and
dimension; only the centroids, CLUSTERS times DIMS integers, come to the driver.

Cases: vectors that are null, of other lengths, or with a null or non-finite component are left out,
as they are no points. Vectors may repeat and ids too: each row counts; of equal ids the smaller
vector is the earlier start. A null id hashes as an empty one. With fewer vectors than CLUSTERS
there are as many centroids as vectors; an empty table gives no rows. Integers of 2^27 and more take
Python's unbounded ones; distances beyond a long are given as the largest long. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import stored
from heron.session import ship

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Dimensions that are added before a centroid is given up.
STEP = 8
#: Vectors that are searched at a time.
BLOCK = 4096
#: Integers below this have squared distances and sums that fit a long.
NARROW = 1 << 27
#: Bits of the limbs that larger integers are summed up in.
LIMB = 30
LONGEST = (1 << 63) - 1


def points(vectors: DataFrame) -> DataFrame:
    """vec_id, x: the kept vectors as whole doubles, not scaled down."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.when((F.size("embedding") == DIMS) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), x)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")).filter("x is not null")


def starts(found: DataFrame, clusters: int = CLUSTERS) -> list[list[int]]:
    """The integer vectors of smallest SHA-256 of "1:" and their id, at most `clusters` rows."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [_integers(r["x"]) for r in found.orderBy(name, "x").limit(clusters).collect()]


def _integers(x: list[float]) -> list[int]:
    return [floor(SCALE * v) if abs(v) < 2**53 else SCALE * int(v) for v in x]


def _matrix(column: pa.Array, wide: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
    return np.array([_integers(v) for v in flat.tolist()], object).reshape(-1, DIMS) if wide else np.floor(SCALE * flat).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; of equally near ones the first."""
    x, centroids = x[:, order], centroids[:, order]
    which, best = np.zeros(len(x), np.int64), ((x - centroids[0]) ** 2).sum(1)
    for c in range(1, len(centroids)):
        alive, part = np.arange(len(x)), np.zeros(len(x), x.dtype)
        for d in range(0, DIMS, STEP):
            part = part + ((x[alive, d : d + STEP] - centroids[c, d : d + STEP]) ** 2).sum(1)
            stay = part <= best[alive]
            alive, part = alive[stay], part[stay]
        closer = part < best[alive]
        which[alive[closer]], best[alive[closer]] = c, part[closer]
    return which, best


def _limbs(v: int, n: int) -> list[int]:
    sign, v = (-1, -v) if v < 0 else (1, v)
    return [sign * (v >> (LIMB * k) & ((1 << LIMB) - 1)) for k in range(n)]


def _searched(found: DataFrame, centroids: list[list[int]], order: list[int], wide: bool, sums: int = 0) -> DataFrame:
    """vec_id, cluster, distance of every vector; or with sums (the limbs of one) cluster, n, total for each task."""
    ship(found.sparkSession)
    kind = object if wide else np.int64

    def blocks(batches: Iterator[pa.RecordBatch]):
        held, by = np.array(centroids, kind), np.array(order)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1), wide)
                yield part.column(0), x, *nearest(x, held, by)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, which, best in blocks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(which, pa.int32()), pa.array(np.minimum(best, LONGEST).astype(np.int64))], ["vec_id", "cluster", "distance"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), kind)
        for _, x, which, _ in blocks(batches):
            for c in np.unique(which):
                n[c] += (which == c).sum()
                total[c] += x[which == c].sum(0)
        some = np.flatnonzero(n)
        rows = [[limb for v in total[c].tolist() for limb in (_limbs(v, sums) if wide else [v])] for c in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(rows, pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return found.mapInArrow(summed, "cluster int, n long, total array<long>") if sums else found.mapInArrow(assign, "vec_id long, cluster int, distance long")


def spread(found: DataFrame) -> dict[int, dict]:
    """Of each dimension the variance, about, and the largest size of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square, most = 0, np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            n, most = n + len(x), np.maximum(most, np.abs(x).max(0, initial=0))
            total, square = total + x.sum(0), square + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMS), pa.int32()), *(pa.array(v, pa.float64()) for v in ([float(n)] * DIMS, total, square, most))], ["d", "n", "total", "square", "most"])

    parts = found.select("x").mapInArrow(run, "d int, n double, total double, square double, most double")
    of = parts.groupBy("d").agg((F.sum("square") / F.sum("n") - (F.sum("total") / F.sum("n")) ** 2).alias("var"), F.max("most").alias("most"))
    return {r["d"]: r.asDict() for r in of.collect()}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    found = stored(points(vectors), "points")
    centroids = starts(found, clusters)
    if not centroids:
        return found.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    seen = spread(found)
    order = sorted(range(DIMS), key=lambda d: (-seen[d]["var"], d))
    most = SCALE * (int(max(r["most"] for r in seen.values())) + 1)
    wide, limbs = most >= NARROW, most.bit_length() // LIMB + 1
    per = limbs if wide else 1
    for _ in range(rounds):
        parts = _searched(found, centroids, order, wide, limbs).select("cluster", "n", F.posexplode("total").alias("at", "v"))
        held: dict[int, tuple[int, list[int]]] = {}
        for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
            held.setdefault(r["cluster"], (r["n"], [0] * DIMS))[1][r["at"] // per] += r["v"] << (LIMB * (r["at"] % per))
        for c, (n, total) in held.items():
            centroids[c] = [v // n for v in total]
    out = stored(_searched(found, centroids, order, wide), "assigned")
    total = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of_cluster")).collect()
    every = sum(int(r["of_cluster"]) for r in total)
    rows = [(r["cluster"], min(int(r["of_cluster"]), LONGEST), min(every, LONGEST), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in total]
    about = out.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
