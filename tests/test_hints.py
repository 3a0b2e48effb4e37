"""Hints with reasons, from links and from texts."""

from heron.functions import hints

LINK, TEXT = "page_id long, pos int, url string, text string, path string", "page_id long, text string"
PACK = {"portal": (["/portal", "/login"], [r"my\s+account"], "high", 1), "docs": (["/docs"], ["sdk"], "medium", 2), "edi": (["/edi"], ["interchange"], "low", 1)}


def test_hints(spark):
    links = [(1, 0, "https://a.org/Portal/x", "Go", "/Portal/x"), (1, 1, "https://a.org/docs", "My  Account", "/docs"), (1, 2, "https://a.org/docs", "sdk", "/docs"), (1, 3, "https://a.org", "login", ""), (1, 4, "https://a.org/Portal/x", "again", "/Portal/x"), (2, 0, None, None, None), (2, 1, "https://b.org/z", "The SDK", "/z")]
    texts = [(1, "Data Interchange and sdk"), (2, "sdk, my account"), (3, "interchange"), (4, None)]
    out = hints.hints(spark.createDataFrame(links, LINK), spark.createDataFrame(texts, TEXT), PACK)
    assert sorted(map(tuple, out.collect())) == [
        (1, "docs", "", "medium", 0, "Page text contains 'sdk'"),
        (1, "edi", "", "low", 0, "Page text contains 'interchange'"),
        (1, "portal", "/Portal/x", "high", 1, "URL pattern '/portal' matched: https://a.org/Portal/x"),
        (1, "portal", "/docs", "high", 1, "Link text matched 'my\\s+account': My  Account"),
        (2, "docs", "/z", "medium", 2, "Link text matched 'sdk': The SDK"),
        (2, "portal", "", "high", 0, "Page text contains 'my\\s+account'"),
        (3, "edi", "", "low", 0, "Page text contains 'interchange'"),
    ]
    assert hints.hints(spark.createDataFrame([], LINK), spark.createDataFrame([], TEXT)).collect() == []
