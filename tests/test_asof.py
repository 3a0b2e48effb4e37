"""The as-of join against brute force."""

import random

import pytest

from heron.functions.asof import asof_join

LEFT, RIGHT = "k string, g int, t long, id int", "k string, g int, s long, seq int, v string"


def sides(seed):
    r = random.Random(seed)
    key = lambda: (r.choice(["a", "b", "hot", "hot", "hot", None]), r.choice([1, 2, 2, None]) if r.random() < 0.3 else 1)
    left = [(*key(), r.choice([None, *range(0, 200)]) if r.random() < 0.1 else r.randint(-20, 200), k) for k in range(300)]
    right = [(*key(), r.randint(0, 180) if r.random() < 0.95 else None, r.randint(0, 3), r.choice(["x", "y", None])) for _ in range(120)]
    return [*left, left[0], left[0]], [*right, right[3], ("late", 1, 500, 0, "z")]


def plain(left, right, strict, within):
    out = []
    for k, g, t, i in left:
        seen = [] if None in (k, g, t) else [(s, seq, (v is not None, v or ""), v) for a, b, s, seq, v in right if (a, b) == (k, g) and s is not None and (s < t or s == t and not strict)]
        best = max(seen, default=None)
        if best and within is not None and t - best[0] > within:
            best = None
        out.append((k, g, t, i, *((best[0], best[1], best[3]) if best else (None, None, None))))
    return sorted(map(str, out))


@pytest.mark.parametrize("bucket,strict,within", [(1000, False, None), (7, False, None), (7, True, None), (1, True, 15), (30, False, 15)])
def test_asof(spark, bucket, strict, within):
    left, right = sides(bucket)
    got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k", "g"], "t", "s", ["seq", "v"], bucket, ["seq"], strict, within)
    assert got.columns == ["k", "g", "t", "id", "s", "seq", "v"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(left, right, strict, within)


def test_empty(spark):
    left, right = sides(1)
    none = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame([], RIGHT), ["k", "g"], "t", "s", ["seq", "v"], 10).collect()
    assert len(none) == len(left) and all(r["s"] is None for r in none)
    assert asof_join(spark.createDataFrame([], LEFT), spark.createDataFrame(right, RIGHT), ["k", "g"], "t", "s", ["v"], 10).collect() == []


def test_a_hot_key_is_split(spark):
    """No group of the first pass holds more than a bucket of rows."""
    n = 20000
    left = spark.range(n).selectExpr("'hot' as k", "id as t")
    right = spark.range(0, n, 50).selectExpr("'hot' as k", "id as s", "id * 2 as v")
    out = asof_join(left, right, ["k"], "t", "s", ["v"], 500)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan
    assert out.filter("v = s * 2 and s = t - t % 50").count() == n
