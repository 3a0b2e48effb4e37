"""Centroid clustering against plain Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from heron.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * v) if abs(v) < 2**53 else 64 * int(v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    held = [x for _, x in first[:clusters]]
    apart = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min((apart(x, c), k) for k, c in enumerate(held))
    for _ in range(rounds):
        mine = {}
        for _, x in kept:
            mine.setdefault(nearest(x)[1], []).append(x)
        for k, xs in mine.items():
            held[k] = [sum(v) // len(xs) for v in zip(*xs, strict=True)]
    out = [(i, *nearest(x)) for i, x in kept]
    total = {k: sum(d for _, d, c in out if c == k) for k in range(clusters)}
    most = lambda v: min(v, 2**63 - 1)
    return sorted(str((i, k, most(d), most(total[k]), most(sum(total.values())), hashlib.sha256(",".join(map(str, held[k])).encode()).hexdigest())) for i, d, k in out)


def result(df, **kw):
    return sorted(str(tuple(r)) for r in centroids.cluster(df, **kw).collect())


def vectors(n, scale=1.0, seed=3):
    r = np.random.default_rng(seed)
    return [(int(k), (scale * v).tolist()) for k, v in enumerate(r.normal(size=(n, 64)) * r.uniform(0.1, 2, 64))]


def odd():
    rows = vectors(60)
    full = rows[0][1]
    return [*rows, (None, rows[1][1]), (None, full), (0, full), (0, rows[2][1]), (70, None), (71, []), (72, full[:63]), (73, [*full, 1.0]), (74, [*full[:63], None]), (75, [*full[:63], math.nan]), (76, [*full[:63], math.inf]), (77, [*full[:63], -math.inf]), (78, [0.0] * 64), (79, [-0.0] * 64)]


@pytest.mark.parametrize("clusters", [16, 1, 200])
def test_cluster(spark, clusters):
    df = spark.createDataFrame(odd(), SCHEMA).withColumns({"cluster": F.lit("x"), "x": F.lit(1), "n": F.lit(2)}).repartition(5)
    assert result(df, clusters=clusters) == plain(odd(), clusters)


def test_ties_take_the_smaller_number(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(40)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


@pytest.mark.parametrize("scale", [1e7, 1e20, 1e200])
def test_large_components(spark, scale):
    rows = vectors(40, scale)
    assert result(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty(spark):
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], SCHEMA)).collect() == []


@pytest.mark.parametrize("step,block", [(1, 7), (64, 4096)])
def test_search_is_exact(monkeypatch, step, block):
    monkeypatch.setattr(centroids, "STEP", step)
    r = np.random.default_rng(1)
    x, c = r.integers(-9, 9, (300, 64)), r.integers(-9, 9, (16, 64))
    c[5] = c[2]
    which, best = centroids.nearest(x, c, r.permutation(64))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (which == full.argmin(1)).all() and (best == full.min(1)).all()


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(str(tuple(r)) for r in __spark_entry__.queries()["op12_centroid_clustering"](spark, sf_dir).collect()) == plain(rows)


def test_query_and_sql(spark, same_as_oracle):
    name = "op12_centroid_clustering"
    same_as_oracle(__spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
