"""Robots decisions against the standard library's parser."""

import random
from urllib.robotparser import RobotFileParser

import pytest

from heron.functions import robots

AGENTS = ["*", "heronbot", "HeronBot", "heron", "other", "Other/2.0", "heronbot/1", "", "%68eron", "bot # ours"]
PARTS = ["", "/", "/a", "/a/", "/a/b", "/private", "/private/open", "/%61", "/a b", "/a%20b", "/*", "/a*", "/x?q=1", "/x?", "/x;p", "/x;", "/ü", "/%C3%BC", "/a%2Fb", "/~u", "/%7eu", "*", "/a+b", "/%zz", "/a&b", "//a", "/x#f", "/%23"]
LINES = ["", "", "# comment", "  ", "no colon", "Sitemap: https://x.org/s.xml", "Crawl-delay: 2", "Crawl-Delay : x", "Request-rate: 1/5", "Unknown: 3", " #", "\x1c"]


def made(r):
    out = []
    for _ in range(r.randint(0, 14)):
        x = r.random()
        if x < 0.3:
            out.append(f"{r.choice(['User-agent', 'user-agent', ' USER-AGENT '])}:{r.choice(['', ' '])}{r.choice(AGENTS)}")
        elif x < 0.75:
            out.append(f"{r.choice(['Disallow', 'Disallow', 'Allow', 'allow '])}: {r.choice(PARTS)}{r.choice(['', '', ' # why'])}")
        else:
            out.append(r.choice(LINES))
    return r.choice(["\n", "\n", "\r\n", "\r"]).join(out)


@pytest.mark.parametrize("limit", [robots.RULE_BYTES, 0])
def test_as_the_standard_parser(spark, monkeypatch, limit):
    monkeypatch.setattr(robots, "RULE_BYTES", limit)
    r = random.Random(7)
    files = [(f"d{k}.org", made(r)) for k in range(2500)]
    asked = [(d, r.choice(["", f"https://{d}"]) + (r.choice(PARTS[1:]).replace("*", "/q", 1) if r.random() < 0.5 else r.choice(PARTS[1:21]) + r.choice(["", "c", "/c", "?z", "%41"])), k) for d, _ in files for k in range(2)]
    asked = [(d, p if p.startswith("http") or p.startswith("/") and not p.startswith("//") else "/" + p.lstrip("/"), k) for d, p, k in asked]
    out = robots.decisions(spark.createDataFrame(asked, "domain string, path string, k int"), spark.createDataFrame(files, "domain string, content string"), "HeronBot/1.0").collect()
    assert len(out) == len(asked)
    parsers = {}
    for d, content in files:
        parsers[d] = RobotFileParser()
        parsers[d].parse(content.splitlines())
    wrong = [(x["domain"], x["path"], x["allowed"]) for x in out if parsers[x["domain"]].can_fetch("HeronBot/1.0", x["path"] if x["path"].startswith("http") else f"https://{x['domain']}{x['path']}") != x["allowed"]]
    assert not wrong, [(w, dict(files)[w[0]]) for w in wrong[:3]]
    assert {x["allowed"] for x in out} == {True, False}


def test_groups(spark):
    def allowed(content, path, agent="HeronBot/1.0"):
        paths = spark.createDataFrame([("a.org", path)], "domain string, path string")
        return robots.decisions(paths, spark.createDataFrame([("a.org", content)], "domain string, content string"), agent).first()["allowed"]

    assert allowed("User-agent: *\nAllow: /private/open\nDisallow: /private", "/private/open/1")
    assert not allowed("User-agent: heronbot\nUser-agent: other\nDisallow: /x", "/x")
    assert allowed("User-agent: *\nDisallow: /\n\nUser-agent: heronbot\nDisallow: /x", "/y")
    assert not allowed("User-agent: *\nDisallow: /a%20b", "/a b")
    assert allowed("User-agent: heronbot\n\nDisallow: /", "/")


def test_odd_rows(spark):
    files = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /x"), ("a.org", "User-agent: *\nDisallow: /y"), ("b.org", None), (None, "User-agent: *\nDisallow: /")], "domain string, content string")
    rows = [("a.org", "/x"), ("a.org", "/x"), ("a.org", "/y"), ("a.org", None), ("b.org", "/x"), (None, "/x"), ("c.org", "/x"), ("a.org", "/" + "z" * 100000)]
    paths = spark.createDataFrame(rows, "domain string, path string").selectExpr("*", "1 as pos", "'q' as allow", "2 as _n")
    out = robots.decisions(paths, files, "heronbot")
    assert out.columns == [*paths.columns, "allowed"]
    assert sorted((str(r["domain"]), str(r["path"])[:9], r["allowed"]) for r in out.collect()) == sorted((str(d), str(p)[:9], (d, p) != ("a.org", "/x")) for d, p in rows)
    empty = spark.createDataFrame([], "domain string, content string")
    assert all(r["allowed"] for r in robots.decisions(paths, empty, "heronbot").collect())
    assert robots.decisions(paths.limit(0), files, "heronbot").collect() == []
