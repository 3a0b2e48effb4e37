"""The probe of a home page."""

from heron.functions import probe

PAGE = """<html><head><meta name="generator" content="WordPress 6"></head><body class="wide content">
<header><a href="/">Home</a><a href="https://www.a.org/services/">Services <b>now</b></a><nav><a href="/services">Again</a><a href="/about/team">Team</a><a href="#x">skip</a><a href="mailto:x@a.org">mail</a><a href="https://b.org/x">Other</a><a href="/none"></a></nav></header>
<input type='password'><form role="search"></form><img loading="lazy" src="x.png"><div class="gdpr load-more"></div><a href="https://c.org/">out</a></body></html>"""


def one(spark, html, url="https://a.org/index"):
    return probe.probes(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string").selectExpr("*", "1 as nav", "2 as anchors")).first()


def test_probe(spark):
    r = one(spark, PAGE)
    assert [(x["text"], x["url"]) for x in r["nav"]] == [("Home", "/"), ("Services now", "/services"), ("Team", "/about/team")]
    assert (r["nav_depth"], r["links"], r["internal_links"], r["external_links"], r["generator"]) == (2, 9, 5, 2, "WordPress 6")
    assert (r["login"], r["search"], r["cookie_banner"], r["lazy_images"], r["endless"], r["main_selector"]) == (True, True, True, True, True, ".content")


def test_pages_that_say_little(spark):
    for html in (None, "", "<p>plain</p>"):
        r = one(spark, html)
        assert r["nav"] == [] and (r["nav_depth"], r["links"], r["internal_links"], r["external_links"]) == (0, 0, 0, 0)
        assert not any(r[c] for c in ("login", "search", "cookie_banner", "lazy_images", "endless", "generator", "main_selector"))
    r = one(spark, '<a href="/x/y">X</a><article></article>' + "z " * 100000)
    assert [x["url"] for x in r["nav"]] == ["/x/y"] and r["main_selector"] == "article"
    assert one(spark, PAGE, None)["page_id"] == 1
