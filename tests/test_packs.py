"""Rule packs as tables against Python's patterns."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from heron.functions import packs

RULE = "pack string, kind string, ord long, label string, pattern string"


def plain(site, path, rules, kind):
    own = site if any(r[0] == site for r in rules) else "default"
    if site is None or path is None:
        return None
    hits = [(r[2], r[3]) for r in rules if r[0] == own and r[1] == kind and re.search(r[4], path, re.IGNORECASE)]
    return min(hits, default=(0, None))[1]


PATTERNS = ["/about", "^/$", "^/?$", "^/index", r"/job\d+", r"\.html$", r"page=\d+", "/car(go|rier)", "a|b", "/x.y", "/se?rv", "/lo+ng", "[abc]def", r"\?q=", "/News", "/é", ".", r"/a\+b", "x{2,3}yz", r"^/de/.*\.pdf$"]


@pytest.mark.parametrize("limit", [packs.RULE_BYTES, 0])
def test_labels(spark, monkeypatch, limit):
    monkeypatch.setattr(packs, "RULE_BYTES", limit)
    r = random.Random(3)
    rules = [(pack, kind, k, f"{pack}{k}", p) for pack in ("a.org", "b.org", "default") for kind in ("page_type", "priority") for k, p in enumerate(r.sample(PATTERNS, 9))]
    paths = ["/", "", "/about", "/ABOUT/us", "/index.html", "/job12", "/?page=3", "/cargo", "/x1y", "/serv", "/srv", "/looong", "/bdef", "/s?q=1", "/news", "/é", "/É", "/a+b", "/xxxyz", "/de/k.pdf", "zz", None, "/" + "long" * 5000]
    rows = [(s, p, k) for k, (s, p) in enumerate((s, p) for s in ("a.org", "b.org", "c.org", None) for p in [*paths, "/about"])]
    df = spark.createDataFrame(rows, "site string, path string, id int").withColumns({"pack": F.lit("q"), "gram": F.lit(1), "label": F.lit(2)})
    out = packs.labels(df, spark.createDataFrame(rules, RULE), ["page_type", "priority"])
    assert out.columns == [*df.columns, "page_type", "priority"]
    got = {x["id"]: (x["page_type"], x["priority"]) for x in out.collect()}
    assert got == {i: (plain(s, p, rules, "page_type"), plain(s, p, rules, "priority")) for s, p, i in rows}


def test_literals_are_needed(spark):
    """Whatever a pattern matches holds its literal."""
    texts = ["/about", "/index", "/job7", "a.html", "page=12", "/cargo", "/carrier", "/x.y", "/xzy", "/srv", "/serv", "/lng", "/long", "/loong", "adef", "?q=", "/news", "/a+b", "xxyz", "xxxyz", "/de/a.pdf", "a", "b"]
    for p, need in spark.createDataFrame([(p,) for p in PATTERNS], "p string").select("p", packs.literal(F.col("p"))).collect():
        assert need is not None and all(need in t.lower() for t in texts if re.search(p, t, re.IGNORECASE)), p
    assert dict(spark.createDataFrame([(p,) for p in PATTERNS], "p string").select("p", packs.literal(F.col("p"))).collect())[r"^/de/.*\.pdf$"] in ("/de/", ".pdf")


def test_ten_thousand_rules_few_patterns(spark):
    """Of ten thousand rules only those whose text an address holds are run."""
    rules = [("big.org", "product", k, f"p{k}", f"/product{k * 7919 % 100003:06d}(?:/|$)".replace("(?:/|$)", "")) for k in range(10000)]
    held = packs.indexed(spark.createDataFrame(rules, RULE)).cache()
    asked = spark.createDataFrame([("big.org", f"/shop/product{k * 7919 % 100003:06d}/view") for k in range(0, 10000, 50)], "pack string, path string")
    assert held.filter("gram = ''").count() == 0
    assert packs.candidates(asked, held).count() == 200
    out = packs.labels(asked.withColumnRenamed("pack", "site"), spark.createDataFrame(rules, RULE), ["product"])
    assert out.filter("product is not null").count() == 200


def test_read_and_broken_patterns(spark, tmp_path):
    profiles = [{"name": "a.org", "rules": {"page_type": {"one": ["/one", "[broken", "*x", "(open"], "two": ["/two"]}, "product": {"p": ["/one"]}}}, {"rules": {}}, {"name": "b.org", "rules": None}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, profiles)) + "\n{broken\n")
    rules = packs.read(spark, str(tmp_path))
    assert [(r["kind"], r["label"], r["pattern"]) for r in rules.filter("pack = 'a.org' and kind = 'page_type'").orderBy("ord").collect()] == [("page_type", "one", "/one"), ("page_type", "one", "[broken"), ("page_type", "one", "*x"), ("page_type", "one", "(open"), ("page_type", "two", "/two")]
    df = spark.createDataFrame([("a.org", p) for p in ("/ONE", "a[broken", "b*x", "c(open", "/two", "/none")], "site string, path string")
    assert {r["path"]: r["page_type"] for r in packs.labels(df, rules, ["page_type"]).collect()} == {"/ONE": "one", "a[broken": "one", "b*x": "one", "c(open": "one", "/two": "two", "/none": None}
    assert packs.labels(df.limit(0), rules, ["page_type"]).collect() == []
    assert {r["page_type"] for r in packs.labels(df, rules.limit(0), ["page_type"]).collect()} == {None}
