"""The filter audit against a walk through all orders."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from heron.llm import audit, common

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((lang or "", {f for f, bad in tests.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        for p in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(p):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(r[0] == part and f in r[1] and bool(r[1] & set(p[:k])) for r in rows)
                unique = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, "".join(p), k + 1] = [len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for f in "ABCDE":
            mine = [key for key in out if key[0] == part and key[1][key[2] - 1] == f]
            total = sum(out[key][1] for key in mine)
            for key in mine:
                out[key].append(total)
    return out


def odd():
    words = " ".join(f"w{k}" for k in range(120))
    docs = [(1, None, "en"), (2, "", "en"), (3, " \t\r\n", None), (4, words, "en"), (5, words, "de"), (4, words, "en"), (6, "A" * 500, ""), (7, words + " #", None), (8, "same " * 150, "en"), (9, "Same same " * 150, "en"), (10, words.upper(), "en")]
    docs += [(None, words, "en"), (None, None, None), (None, "x", "xx"), (11, words + "\x1c" + words, "en"), (12, "É" * 90 + "ABCDEFGHIJ", "de"), (13, ("long words here " * 9000) + "$", "en")]
    docs += [(100 + k, "copy of one text " + words, ["en", "de", None][k % 3]) for k in range(40)]
    labels = [(4, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1), (101, 1, None), (102, 1, 1), (7, 1, 0), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("least", [200, 3])
def test_audit(spark, monkeypatch, least):
    monkeypatch.setattr(common, "HEAVY_LEAST", least)
    docs, labels = odd()
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("z") for c in ("part", "mask", "words", "cnt", "first", "n", "quality")})
    out = audit.audit(df, spark.createDataFrame(labels, LABELS).withColumn("good", F.lit(7))).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in out} == plain(docs, labels)
    assert len(out) == 600 * len({d[2] or "" for d in docs})


def test_empty(spark):
    docs, labels = odd()
    assert audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []
    none = audit.audit(spark.createDataFrame(docs[:3], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(none) == 1200 and not any(r["good_lost"] or r["toxic_lost"] for r in none)


def test_query_and_sql(spark, same_as_oracle):
    name = "op13_filter_audit"
    same_as_oracle(__spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
