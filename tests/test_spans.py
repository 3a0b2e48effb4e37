"""Span arrays and the interval join against Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heron import rules
from heron.functions import spans
from heron.functions import text as T


def texts():
    r = random.Random(5)
    bits = ["$5", "$1,200.50", "3 cents per mile", "12 CPM", "4.5%", "$2/mile", "😀", "é", "\n", " ", "  ", "word ", "May 3, 2021", "2020-11-02", "Q3 quarter", "𝒳y ", "５%", " ", "k"]
    out = ["", " ", "$5", "no match", "😀$5😀", None]
    out += ["".join(r.choices(bits, k=r.randint(1, 40))) for _ in range(150)]
    return [*out, "$7 " * 3000, "x" * 5000 + "$7" + "y" * 4094 + "$8 😀", "😀" * 4095 + "$9 " + "😀" * 9000]


def plain(t, patterns, around):
    found = [(m, u) for p, u in patterns for m in re.finditer(p, t or "", re.IGNORECASE)]
    return [(m.start(), m.end(), m.group(), u, t[max(0, m.start() - around) : m.end() + around].strip()) for m, u in found]


@pytest.mark.parametrize("run,block", [(256, 4096), (3, 7)])
def test_located(spark, monkeypatch, run, block):
    monkeypatch.setattr(spans, "RUN", run)
    monkeypatch.setattr(spans, "BLOCK", block)
    patterns = [*rules.MONEY, *((p, "date") for p in rules.DATES)]
    rows = list(enumerate(texts() if block > 100 else texts()[:-3]))
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r["id"]: [tuple(m) for m in r["m"]] for r in df.select("id", spans.located(F.col("text"), patterns, 20).alias("m")).collect()}
    assert all(out[i] == plain(t, patterns, 20) for i, t in rows)
    money = {r["id"]: [(m["raw"], m["unit"], m["context"]) for m in r["m"]] for r in df.select("id", T.money(F.col("text")).alias("m")).collect()}
    assert all(money[i] == [(m[2], m[3], m[4]) for m in plain(t, rules.MONEY, 50)] for i, t in rows)


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([("a $5",)], "text string")
    df.select(T.money(F.col("text")), T.dates(F.col("text"))).explain()
    assert "Python" not in (said := capsys.readouterr().out) and "Arrow" not in said


def test_spans_and_between(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    for t, s, b in df.select("text", spans.spans(F.col("text"), r"[. \n]+"), spans.between(F.col("text"), r"[. \n]+")).collect():
        found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[. \n]+", t or "")]
        assert (t is None and s is None and b is None) or [tuple(x) for x in s] == found
        if t is not None:
            assert [t[x["start"] : x["end"]] for x in b] == re.split(r"[. \n]+", t)


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 700):
        v = list(range(n))
        assert spark.range(1).select(spans.running(F.lit(v) if v else F.array().cast("array<int>"))).first()[0] == [sum(v[: k + 1]) for k in range(n)]


@pytest.mark.parametrize("width", [1, 10, 100000])
def test_interval_join(spark, width):
    r = random.Random(2)
    some = lambda n: [(r.choice(["a", "b", None]), x, x + r.randint(0, 40), k) for k in range(n) for x in [r.randint(0, 300)]]
    left, right = some(80), [*some(80), ("a", 0, 400, 900), ("a", 5, None, 901)]
    got = spans.interval_join(spark.createDataFrame(left, "key string, start int, end int, l int"), spark.createDataFrame(right, "key string, other_start int, other_end int, r int"), ["key"], width)
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] is not None and a[0] == b[0] and b[2] is not None and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])
    assert sorted((x["l"], x["r"]) for x in got.collect()) == want
