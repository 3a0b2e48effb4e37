"""SimHash near-dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from heron.llm import simhash

DOCS = "doc_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = [x for x in (text or "").translate(FOLD).encode().split()]
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(prints):
    """component_id of rows (doc_id, fingerprint)."""
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    ids = {}
    for k, (i, _) in enumerate(prints):
        ids.setdefault(find(k), []).append(i)
    return [min((i for i in ids[find(k)] if i is not None), default=None) for k in range(len(prints))]


def chained():
    """Texts whose fingerprints form chains and stars, copies and odd rows."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(6):
        base = r.choices(words, k=200)
        for _ in range(25):
            mine = list(base)
            for _ in range(r.randint(0, 6)):
                mine[r.randrange(200)] = r.choice(words)
            rows.append((len(rows) + 10, " ".join(mine)))
            if r.random() < 0.2:
                base = mine
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "two Words"), (5, "TWO words"), (6, "été"), (7, "ÉTÉ"), (8, "a b c"), (9, "w" * 70000), (900, "x\x1cy z")]
    rows += [(None, rows[0][1]), (None, "nobody's own text"), (10, rows[0][1]), (10, rows[30][1])]
    return rows


@pytest.mark.parametrize("chunk,n", [(1024, None), (16, 1), (4, 3), (64, 8)])
def test_near_dedup(spark, monkeypatch, chunk, n):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    if n:
        monkeypatch.setattr(simhash, "slices", lambda nodes: n)
    rows = chained()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit(1), "comp": F.lit("z"), "cnt": F.lit(0), "tile": F.lit(3)})
    prints = [(i, plain(t)) for i, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(prints, components_of(prints), strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_dedup(docs).collect()) == want


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [(r["doc_id"], plain(r["text"])) for r in docs]
    want = {i: (f"{p:016x}", c) for (i, p), c in zip(prints, components_of(prints), strict=True)}
    out = __spark_entry__.queries()["op11_simhash_near_dedup"](spark, sf_dir).collect()
    assert len(out) == len(docs) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == want


def test_empty(spark):
    assert simhash.near_dedup(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for text in ("", " ", "a", "a b", "a  b\nc", " lead and trail ", "one two three four five\tsix\x0bseven " * 9, "x" * 500 + " y"):
        assert simhash.fingerprint(text.encode()) == plain(text)


@pytest.mark.parametrize("n", range(1, 9))
def test_tiles_hold_every_link(spark, n):
    """Fingerprints in reach lie in tiles whose names differ by an offset."""
    r = np.random.default_rng(n)
    x = r.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 300, dtype=np.uint64)
    y = x.copy()
    for k in range(300):
        for b in r.choice(64, r.integers(0, 4), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    df = spark.createDataFrame([(k, int(v)) for k, v in enumerate(np.concatenate([x, y]).view(np.int64))], "k long, fp long")
    name = {r["k"]: r["t"] for r in df.select("k", simhash._tile(n).alias("t")).collect()}
    steps = {sum(v * simhash.DIGIT**k for k, v in enumerate(d)) for d in simhash._offsets(n)}
    assert all(name[k] - name[k + 300] in steps for k in range(300))


def test_slices_grow():
    assert [simhash.slices(10**k) for k in (2, 5, 9)] == sorted(simhash.slices(10**k) for k in (2, 5, 9))
    assert simhash.slices(100) == 1 and simhash.slices(10**9) > 4
