from pyspark.sql import functions as F

from heron import registry
from heron.functions import detect, markup, media, page, text, urls
from heron.functions.dom import Dom
from heron.streaming import telemetry


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first()["x"]


def test_canonical_urls(spark):
    cases = {
        "HTTPS://WWW.Acme.com/A/b/?utm_source=x&b=2&a=1&a=0#top": "https://acme.com/A/b?a=1&a=0&b=2",
        "http://acme.com": "http://acme.com/",
        "http://acme.com/?q=": "http://acme.com/?q=",
        "http://awww.com/x//": "http://awww.com/x",
    }
    for url, want in cases.items():
        assert one(spark, urls.canonical, url) == want


def test_null_and_odd_urls(spark):
    assert one(spark, urls.canonical, None) == ":///"
    assert one(spark, urls.host, "not a url") == ""


def test_resolve(spark):
    base = F.lit("https://a.org/x/y?q=1#f")
    for href, want in {"/z": "https://a.org/z", "z": "https://a.org/x/z", "//b.org/": "https://b.org/", "#t": "https://a.org/x/y?q=1", "?p=2": "https://a.org/x/y?p=2", "mailto:a@b": "mailto:a@b"}.items():
        assert one(spark, lambda c: urls.resolve(base, c), href) == want


def test_money(spark):
    found = one(spark, text.money, "Pay is 62 cents per mile or $0.55/mile, $5,000 bonus, $25.50 per hour, 4.5%")
    assert [(m["raw"], m["unit"], m["amount"]) for m in found if m["unit"] != "dollar"] == [("62 cents per mile", "per_mile", 0.62), ("$0.55/mile", "per_mile", 0.55), ("$25.50 per hour", "per_hour", 25.5), ("4.5%", "percent", 4.5)]
    assert one(spark, text.money, None) == []


def test_sentiment_and_audience_without_words(spark):
    assert one(spark, text.sentiment, "").asDict() == {"positive": 0, "negative": 0, "ratio": 0.5, "tone": "neutral"}
    assert one(spark, text.audience, "nothing here") == "general"


def test_similarity_bounds(spark):
    same = spark.createDataFrame([("a b c d", "a b c d"), ("a b c d", "x y z w"), ("", "a b c")], "x string, y string").select(text.similarity(F.col("x"), F.col("y")).alias("s")).collect()
    assert [r["s"] for r in same] == [1.0, 0.0, 0.0]


def test_js_detection(spark):
    assert one(spark, detect.js_required, '<div id="root"></div>').asDict(True) == {"required": False, "confidence": "low", "framework": None, "signals": ["empty_root_div:root"]}
    v = one(spark, detect.js_required, "<noscript>You need to enable JavaScript</noscript>")
    assert v["required"] and v["confidence"] == "high"
    assert one(spark, detect.js_required, '<html ng-version="1"></html>')["framework"] == "angular"
    assert one(spark, detect.js_required, None)["required"] is False


def test_policy_ladder(spark):
    def ask(current, outcome, attempt=0, retries=0, stealth=True, visible=True, ceiling=None):
        c = map(F.lit, (current, outcome, attempt, retries, 3, stealth, visible))
        return spark.range(1).select(detect.next_strategy(*c, F.lit(ceiling).cast("string")).alias("s")).first()["s"]

    assert ask("requests", "success_real_content") is None
    assert ask("requests", "hard_block") is None
    assert ask("requests", "timeout") == "requests"
    assert ask("requests", "timeout", retries=1) == "js"
    assert ask("js", "soft_block", stealth=False) == "visible"
    assert ask("js", "soft_block", stealth=False, visible=False) is None
    assert ask("js", "soft_block", ceiling="js") is None
    assert ask("js", "soft_block", attempt=2) is None


def test_dom_of_broken_markup():
    assert list(Dom(None).all()) == [] and Dom(None).text(0) == ""
    d = Dom("<h1>a<b>b</h1></div><p>one<p>two<ul><li>x<li>y</ul><script>var a = '<p>';</script>")
    assert [d.tag[i] for i in d.all()] == ["h1", "b", "p", "p", "ul", "li", "li", "script"]
    assert [d.clean(i) for i in d.all(("h1", "p", "li"))] == ["ab", "one", "two", "x", "y"]
    assert d.clean(0) == "abonetwoxy"
    deep = Dom("<div>" * 5000 + "x")
    assert deep.clean(0) == "x" and len(deep.tag) == 5001


def test_footer_without_a_footer():
    links = "".join(f'<a href="/{i}">l{i}</a>' for i in range(6))
    assert page.footer_container(Dom(f"<div>text</div><div id='foot'><p>copyright us</p>{links}</div>")) is not None
    d = Dom(f"<div class='SiteFooter'><a href='/x'>x</a></div><div>{links}</div>")
    assert d.attrs[page.footer_container(d)]["class"] == "SiteFooter"
    assert page.footer_container(Dom("<p>copyright</p>")) is None
    many = "".join(f'<a href="/{i}">l{i}</a>' for i in range(12))
    assert page.footer_container(Dom(f"<body><div>{many} privacy</div><p>x</p></body>")) is not None


def test_hero_without_a_hero():
    assert page.hero(Dom("<main><h1>Head</h1><div>x</div><p>para</p></main>")) == "Head para"
    assert page.hero(Dom("<div class='banner'>short</div><p>x</p>")) == ""
    assert page.hero(Dom("<div class='splash'>a splash of more than twenty characters</div>")) == "a splash of more than twenty characters"


def test_nav_containers():
    tag = lambda h: (lambda d, i: None if i is None else (d.tag[i], d.attrs[i].get("class")))(d := Dom(h), page.nav_container(d))
    assert tag("<nav>a</nav><nav class='primary'>b</nav>") == ("nav", "primary")
    assert tag("<header><div class='toolbar'></div></header><nav></nav>") == ("div", "toolbar")
    assert tag("<header><p></p></header><nav></nav>") == ("header", None)
    assert tag("<div class='main-nav'></div>") == ("div", "main-nav") and tag("<p></p>") is None


def test_density():
    thin = Dom("<body><div class='cookie'>cookies cookies</div>" + "<p>some words outside of every container here</p>" * 40 + "<div>" + "a small container of words in a page of many words" + "</div></body>")
    found = page.main_text(thin)
    assert found["place"] == "stripped body" and "cookies" not in found["text"] and found["link_density"] == 0.3
    dense = Dom("<nav><a href='/'>home</a></nav><section>" + "dense words in a section " * 30 + "</section><div><a href='/x'>" + "linked words only here " * 30 + "</a></div>")
    assert page.main_text(dense)["place"] == "densest" and page.main_text(dense)["text"].startswith("dense words")
    assert page.main_text(Dom("<p>only this</p>")) == {"text": "only this", "link_density": 0.5, "place": "body"}
    assert page.main_text(Dom(""))["place"] == "none"


def test_tagged_sections_and_nesting():
    d = Dom("<h1>One</h1><h3>Three</h3><p>twenty characters or more</p><h2>Two</h2><img src='a.png' width='10px' height='4'><aside><p>twenty characters in an aside</p></aside>")
    rows = page.sections(d, "https://a.org/x/")
    assert [(r["kind"], r["text"], r["parent"]) for r in rows] == [("section", "One", None), ("section", "Three", 0), ("text", "twenty characters or more", 1), ("section", "Two", 0), ("image", None, 3)]
    assert rows[-1]["src"] == "https://a.org/x/a.png" and rows[-1]["width"] is None and rows[-1]["height"] == 4
    tree = page.nested(rows)
    assert [c["text"] for c in tree["children"]] == ["One"] and [c["text"] for c in tree["children"][0]["children"]] == ["Three", "Two"]
    blocks = page.tagged_blocks([{"text": "N", "url": "/n"}], [], "the hero", [{"type": "image", "content": "alt", "url": "/i", "level": None}], [], "no notice")
    assert [(r["kind"], r["text"], r["parent"], r["tag"]) for r in page.tagged_sections(blocks)] == [("section", "nav_block", None, None), ("section", "hero_block", None, None), ("section", "main_block", None, None), ("text", "N", 0, "link"), ("text", "the hero", 1, "tagged"), ("image", "alt", 2, "tagged")]


def test_images_of_a_page():
    d = Dom('<meta property="og:image" content="/card.png"><meta name="twitter:image" content="/card.png"><div class="x"><h2>Head <b>line</b></h2><img src="data:image/gif;base64,x"><img src="logo.svg" alt="Acme"><img src="/p.png" width="3" height="3"></div><img src="/late.png"><p>a paragraph of more than twenty characters</p>')
    kinds = {x["src_resolved"]: x for x in media.images(d, "https://a.org/")}
    assert list(kinds) == ["https://a.org/logo.svg", "https://a.org/late.png", "https://a.org/card.png"]
    assert kinds["https://a.org/logo.svg"]["context_heading"] == "Headline" and kinds["https://a.org/logo.svg"]["classification"] == "logo"
    assert kinds["https://a.org/late.png"]["context_text"] == "a paragraph of more than twenty characters" and kinds["https://a.org/late.png"]["context_heading"] == "Headline"
    assert kinds["https://a.org/card.png"]["source_tag"] == "og:image" and kinds["https://a.org/card.png"]["classification"] == "photo"
    assert len(media.images(d, "https://a.org/", decorative=True)) == 4


def test_codes_of_a_page():
    d = Dom('<p>src/main.rs</p><pre><code class="hljs rust">fn main() { println!("x"); }</code></pre><p>too short</p><code style="display: block">one line that stands alone</code><script type="application/json">{"a": 1, "b": [1, 2, 3]}</script><pre>short</pre><div class="code-shell"><pre>echo one two three four</pre></div>')
    found = media.codes(d, config=True)
    assert [(c["source_tag"], c["language"], c["confidence"], c["filename_hint"]) for c in found] == [("pre", "rust", 0.9, "src/main.rs"), ("pre", "bash", 0.7, None), ("code", None, 0.0, None), ("script", "json", 1.0, None)]
    assert media.cleaned("12: alpha\n13: beta...") == ("alpha\nbeta...", True) and media.cleaned("1 \n2 \n3 ")[0] == "1 \n2 \n3"
    assert media.language_name("YML ") == "yaml" and media.language_name(None) is None and media.language_name("zig") == "zig"


def test_hints_of_a_page():
    links = [{"url": "https://a.org/docs/x", "text": "Docs"}, {"url": "https://a.org/go", "text": "Track your shipment"}]
    found = page.hints(links, "we offer edi integration")
    assert [(h["feature"], h["subtree"], h["priority"], h["depth_boost"]) for h in found] == [("tracking", "/go", "high", 1), ("api_docs", "/docs/x", "high", 2), ("edi", "", "medium", 0)]
    assert [h["feature"] for h in page.hints(links, "", wanted=["Tracking"])] == ["tracking"]
    assert page.hints([{"url": "http://[", "text": "login"}], "") == []


def test_scan_of_a_page():
    html = '<a href="/track/1">Track</a><form action="/quote"><input name="a"><textarea name="t"></textarea></form><form><input type="hidden"></form>sign in with Google and salesforce<script>fetch("/api/v2/x")</script>'
    s = page.scan(Dom(html), html, "https://a.org/")
    assert [x["type"] for x in s["portal_links"]] == ["tracking"] and [f["purpose"] for f in s["forms"]] == ["quote"]
    assert s["providers"] == ["Google OAuth"] and s["integrations"] == ["Salesforce"] and s["endpoints"] == ["/api/v2/x", "/api/v2/"]
    assert s["feature_count"] == 5 and s["portal_count"] == 1


def test_code_without_line_numbers(spark):
    clean = lambda c: markup.cleaned(c)["code"]
    assert one(spark, clean, "1: import os\n2: print(os)") == "import os\nprint(os)"
    assert one(spark, clean, "1 \n2 \n3 ") == "1 \n2 \n3"
    assert one(spark, lambda c: markup.cleaned(c)["truncated"], "a = 1  # ...") is True


def test_amounts(spark):
    cases = {"$5k": 5000.0, "$2 million": 2e6, "$5M": 5e6, "$0.55/mi": None, "62 cents": 62.0, "$1.2.3": None, "4.5%": 4.5, "$,": None, "58 cpm": 58e6}
    for raw, want in cases.items():
        assert one(spark, lambda c: text.amount(c, F.lit("dollar")), raw) == want, raw
    assert one(spark, lambda c: text.amount(c, F.lit("per_mile")), "62 cents per mile") == 0.62


def test_stream_and_batch_counters_agree(spark, sf_dir, tmp_path):
    out = telemetry.drain(telemetry.counters(telemetry.events(spark, sf_dir)), str(tmp_path / "c"), "complete")
    assert out.agg(F.sum("attempts")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_backoff_and_expiring_reads_all_events(spark, sf_dir):
    assert registry.QUERIES["backoff_and_expiring"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_money_said_twice(spark, tmp_path):
    spark.createDataFrame([(0, "pay of $900 now. " + "x" * 60 + " the drivers pay is $900 and bonus", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r for r in registry.QUERIES["text_money_dedup"](spark, str(tmp_path)).collect() if r["raw"] == "$900"]
    assert len(rows) == 1
    assert len([r for r in registry.QUERIES["text_money"](spark, str(tmp_path)).collect() if r["raw"] == "$900"]) == 2


def test_enriched_reads_every_document(spark, sf_dir):
    rows = registry.QUERIES["enriched_pages"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    told = rows.filter("doc_id % 6 = 2").first()
    assert {"March 5, 2021", "2020-11-02"} <= {d["raw"] for d in told["dates"]}
    assert {"Texas", "New York"} <= set(told["locations"])
