"""Features of a page in Columns."""

from heron.functions import features

PAGE = """<a href="/customer/login">In</a><a href="/x">Carrier /driver</a><form action="/pro-search"><input type=text name="a"><INPUT TYPE='submit'></form>
<form action="/login"><input name="u"><input type="PASSWORD"></form><form action="/search"><input type="hidden"><input type='button'></form><form action="/odd"><textarea></textarea></form>
<form action='/contact'><select name="s"></select></form> Sign in with Okta. Uses SAP TM and McLeod <script>axios.get('/api/x')</script>"""


def rows(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string").selectExpr("*", "1 as text", "2 as anchors")
    return sorted(tuple(r)[1:] for r in features.features(df).collect())


def test_features(spark):
    found = rows(spark, PAGE)
    assert [f for f in found if f[0] == "portal"] == [("portal", "carrier_portal", 0.8), ("portal", "customer_portal", 0.8), ("portal", "login", 0.8)]
    assert [f for f in found if f[0] == "form"] == [("form", "contact", 0.5), ("form", "login", 0.7), ("form", "tracking", 0.5)]
    assert ("integration", "oauth", 0.9) in found and found.count(("integration", "tms", 0.6)) == 2 and ("api", "endpoint", 0.7) in found


def test_pages_that_offer_nothing(spark):
    assert rows(spark, None) == rows(spark, "") == rows(spark, "<p>" + "plain " * 50000) == []
