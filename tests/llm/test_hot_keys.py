"""Hot keys: the ways that only large inputs take, forced by low thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from heron.llm import common, exact_dedup, minhash, repeats
from tests.llm.test_groups import DOCS, brute_repeats, components_of, near_copies


@pytest.fixture
def low(monkeypatch):
    monkeypatch.setattr(common, "HEAVY_LEAST", 2)
    monkeypatch.setattr(common, "HEAVY_PARTS", 20)


def test_skew_join(spark, low):
    left = spark.createDataFrame([(k % 7 if k % 2 else 3, k) for k in range(200)], "k int, v int")
    right = common.stored(left.groupBy("k").agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("m")).filter("k <> 5"))
    assert not common.heavy(right, 200)[1].isEmpty()
    for how in ("inner", "left"):
        rows = lambda df: sorted(str(tuple(r)) for r in df.select("k", "v", "cnt", "m").collect())
        assert rows(common.skew_join(left, right, ["k"], 200, how)) == rows(left.join(right, "k", how))


def test_exact_dedup_of_a_hot_text(spark, low, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FEW_PRINTS", 0)
    rows = [(i, "same text in many blocks" if i % 3 else f"own {i % 5}") for i in range(60)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), 4).collect()
    top, size = {}, {}
    for i, t in rows:
        top[t], size[t] = max(i, top.get(t, i)), size.get(t, 0) + 1
    said = dict(rows)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out} == {(i, top[said[i]], size[said[i]]) for i, _ in rows}


def test_near_dedup_of_a_hot_group(spark, low, monkeypatch):
    monkeypatch.setattr(minhash, "SALT_ROWS", 2)
    monkeypatch.setattr(minhash, "HEAVY_PARTS", 20)
    rows = near_copies()
    out = minhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == components_of(rows)


def test_repeats_of_a_hot_line(spark, low, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 3)
    r = random.Random(5)
    noise = lambda n: "".join(r.choices("abcdefgh", k=n))
    line = noise(230)
    texts = [noise(40) + line + noise(60) for _ in range(25)] + [line] * 5 + [noise(500)]
    out = {x["doc_id"]: bytes(x["kept"]) for x in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts, "none")


@pytest.mark.parametrize("keep", ["none", "first"])
def test_windows_within_a_hot_passage_are_folded_by_ranges(spark, low, monkeypatch, keep):
    """Not dealt out one by one: what a text in which the passage stands adds to the narrowest table doesn't grow with the passage."""
    monkeypatch.setattr(repeats, "TOGETHER", 3)
    seen, stored = [], repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, label="step": (seen.append((label, t := stored(df, label))), t)[1])
    r = random.Random(6)
    noise = lambda n: "".join(r.choices("abcdefgh", k=n))
    passage = noise(330)
    texts = [noise(90 + i) + passage + noise(60) for i in range(12)] + [noise(400)]
    out = {x["doc_id"]: bytes(x["kept"]) for x in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS), keep).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts, keep)
    dealt = [t.count() for label, t in seen if label == "narrowed"]
    assert dealt and max(dealt) < 12 * 40


def test_near_dedup_of_clusters_around_a_template(spark, monkeypatch):
    """Clusters that share a template lie in one group; those out of reach of each other are left out of the squares, chains of links are not lost."""
    r = random.Random(11)
    template = [f"t{i}" for i in range(70)]
    rows = []
    for c in range(6):
        own = [f"c{c}_{i}" for i in range(30)]
        base = template + own
        for k in range(8):
            mine = list(base)
            for _ in range(r.randint(0, 2)):
                mine[r.randrange(len(mine))] = f"x{c}_{k}_{r.randrange(999)}"
            if c in (4, 5):  # two clusters that drift towards each other
                mine[70 : 70 + 4 * k] = [f"d_{i}" for i in range(4 * k)]
            rows.append((100 * c + k + 1, " ".join(mine)))
    seen = []
    reachable = minhash._reachable

    def watched(of_split, sets):
        near = reachable(of_split, sets)
        seen.append((of_split.select("centre", "comp").distinct().count(), near.count()))
        return near

    monkeypatch.setattr(minhash, "_reachable", watched)
    out = minhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == components_of(rows)
    assert seen and seen[0][1] < seen[0][0], seen
