"""Frontier, nested site maps and running sums against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from heron.functions import budget, frontier, sitemaps

ROW, SEEN = "site string, address string, path string, ofs long", "site string, address string"


@pytest.mark.parametrize("per", [2048, 3])
def test_fresh_is_exact(spark, monkeypatch, per):
    monkeypatch.setattr(frontier, "SLOT_ADDRESSES", per)
    r = random.Random(1)
    seen = [(r.choice(["a", "b"]), f"u{r.randint(0, 400)}") for _ in range(300)] + [(None, "u1"), ("a", None)]
    found = [(s, f"u{k}", k) for s in ("a", "b", "c") for k in range(0, 500)]
    got = frontier.fresh(spark.createDataFrame(found, "site string, address string, k int"), spark.createDataFrame(seen, SEEN))
    assert sorted(map(tuple, got.collect())) == sorted(f for f in found if f[:2] not in set(seen))
    assert frontier.fresh(spark.createDataFrame(found, "site string, address string, k int"), spark.createDataFrame([], SEEN)).count() == len(found)


def test_filters_pass_few(spark):
    """The Bloom filters leave few unseen addresses to the exact join, and no seen one out."""
    seen = spark.range(10000).selectExpr("'a' as site", "concat('u', id) as address")
    filters = frontier.seen_filters(seen)
    assert filters.count() == 5 and {len(r["bits"]) for r in filters.collect()} == {4096}
    probe = spark.range(20000).selectExpr("'a' as site", "concat('u', id) as address", "id").join(filters, "site").filter(F.col("slot") == frontier._slot(F.col("address"), F.col("slots")))
    hit = probe.filter(frontier._all_set(F.col("bits"), frontier._bits(F.col("address"))))
    assert hit.filter("id < 10000").count() == 10000 and hit.filter("id >= 10000").count() < 300


def test_frontier(spark):
    start = [("a.org", "https://a.org/private", "/private", 0)]
    listed = [("a.org", f"https://a.org/{k}", f"/{k}", k) for k in range(200)] + [("a.org", "https://a.org/0", "/0", 5), ("a.org", "https://a.org/private/x", "/private/x", -1), ("b.org", "https://b.org/z", "/z", 3), ("b.org", "https://b.org/y", "/y", 3), ("b.org", None, None, 1), (None, "x", "x", 1)]
    seen = [("a.org", "https://a.org/1"), ("b.org", "https://a.org/2")]
    files = [("a.org", "User-agent: *\nDisallow: /private"), ("c.org", "User-agent: *\nDisallow: /")]
    out = frontier.frontier(*(spark.createDataFrame(x, s) for x, s in ((start, ROW), (listed, ROW), (seen, SEEN), (files, "domain string, content string"))), "bot", 50)
    by = sorted(map(tuple, out.collect()))
    assert by[:4] == [("a.org", 1, "https://a.org/private"), ("a.org", 2, "https://a.org/0"), ("a.org", 3, "https://a.org/2"), ("a.org", 4, "https://a.org/3")]
    assert [x for x in by if x[0] == "b.org"] == [("b.org", 1, "https://b.org/y"), ("b.org", 2, "https://b.org/z")]
    assert len(by) == 52


def index(*children):
    return '<?xml version="1.0"?><sitemapindex>' + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"


def urls(*locs):
    return '<?xml version="1.0"?><urlset>' + "".join(f"<url><loc>{u}</loc></url>" for u in locs) + "</urlset>"


def test_nested_site_maps(spark):
    """A cycle, a diamond, a chain, a map that isn't there and a broken one."""
    maps = [("r", index("a", "b", "gone")), ("a", index("c", "r")), ("b", index("c", "d1")), ("c", urls("u1", "u2")), ("d1", index("d2")), ("d2", index("d3")), ("d3", index("d4")), ("d4", urls("deep")), ("s", urls("u1")), ("broken", "<urlset><url>"), ("null", None), (None, urls("nobody"))]
    m, roots = spark.createDataFrame(maps, "source string, xml string"), spark.createDataFrame([("r",), ("s",), ("r",), ("broken",), (None,)], "source string")
    got = sorted(map(tuple, sitemaps.reached(m, roots, 4).collect()))
    assert got == [("broken", "broken", 0), ("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "d1", 2), ("r", "d2", 3), ("r", "d3", 4), ("r", "gone", 1), ("r", "r", 0), ("s", "s", 0)]
    assert sorted((x["root"], x["loc"], x["depth"]) for x in sitemaps.all_urls(m, roots, 5).collect()) == [("r", "deep", 5), ("r", "u1", 2), ("r", "u2", 2), ("s", "u1", 0)]
    assert sorted(x["source"] for x in sitemaps.reached(m, roots, 0).collect()) == ["broken", "r", "s"]
    assert sitemaps.reached(m, roots.limit(0)).collect() == []


def test_prefixed_maps(spark):
    sm = 'xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = [("i", f"<sm:sitemapindex {sm}><sm:sitemap><sm:loc> m </sm:loc></sm:sitemap></sm:sitemapindex>"), ("m", f"<sm:urlset {sm}><sm:url><sm:loc>u</sm:loc><sm:priority>0.5</sm:priority></sm:url></sm:urlset>")]
    m = spark.createDataFrame(maps, "source string, xml string")
    assert [(x["root"], x["loc"], x["depth"]) for x in sitemaps.all_urls(m, m.select("source").filter("source = 'i'")).collect()] == [("i", "u", 1)]


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_running_sums(spark, ranges):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), k, r.choice([None, 1, 5, 20])) for k in range(400)]
    out = budget.running_sums(spark.createDataFrame(rows, "k string, n int, v int"), ["k"], ["n"], "v", ranges).collect()
    held, want = {}, []
    for k, n, v in rows:
        want.append((str(k), n, held.get(k, 0)))
        held[k] = held.get(k, 0) + (v or 0)
    assert sorted((str(x["k"]), x["n"], x["held"]) for x in out) == sorted(want)


def test_a_hot_key_runs_in_many_tasks(spark):
    out = budget.running_sums(spark.range(5000).selectExpr("'hot' as k", "id as n", "1 as v"), ["k"], ["n"], "v", 8)
    assert out.filter("held = n").count() == 5000
    assert out.sparkSession.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).select("_range").distinct().count() == 8
