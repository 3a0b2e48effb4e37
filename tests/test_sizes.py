"""What only larger tables show: long page numbers, rows in any order."""

import datetime

import duckdb

from heron import registry


def test_section_tree_of_pages_with_long_numbers(spark, tmp_path):
    """From page 1000 on the planted caption has 20 characters."""
    pages = [(n, f"https://a.example/{n}", "<html><body><h2>Own</h2><p>Some text of the page itself.</p></body></html>") for n in (7, 999, 1000, 123456)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    names = ["page_id", "kind", "level", "text", "words", "parent_text"]
    got = registry.QUERIES["html_section_tree"](spark, str(tmp_path)).select(names).collect()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(names)} from ({registry.ORACLES['html_section_tree']})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_drift_sums_in_order_of_events(spark, tmp_path):
    """Sums of doubles in another order are -0.3 exactly, which is no drop."""
    days = {1: [(0, 123.4)], 2: [(1, 1.12), (2, 23.05), (3, 62.21)]}
    rows = [(i, datetime.datetime(2024, 1, d, 1, i), 1, "view", v) for d, held in days.items() for i, v in held]
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    want = con.execute(f"select change, alerts from ({registry.ORACLES['drift']})").fetchall()
    assert list(map(tuple, registry.QUERIES["drift"](spark, str(tmp_path)).select("change", "alerts").collect())) == want


def test_grades_cut_sentences_once(spark, sf_dir):
    """A condition that repeats an expression computes it again."""
    plan = registry.QUERIES["text_grades_all"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[.!?]+") == 1


def plan(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_enriched_documents_asks_for_no_places(spark, sf_dir):
    """A record of amounts and dates as written needs no pieces of text, and words are cut once."""
    said = plan(spark, sf_dir, "enriched_documents")
    assert "{1,4096}" not in said and said.count(r"(?U)(\w+)") == 1


def test_enriched_pages_lowers_and_cuts_once(spark, sf_dir):
    """What stands inside a lambda is computed again for each of its uses."""
    said = plan(spark, sf_dir, "enriched_pages")
    assert said.count("lower(text") <= 8 and said.count(r"(?U)(\w+)") == 1


def test_enriched_summary_only_counts(spark, sf_dir):
    said = plan(spark, sf_dir, "enriched_summary")
    assert "{1,4096}" not in said and "split(" not in said and said.count("lower(text") <= 2


def test_names_under_their_letters(spark):
    """Names tried letter by letter are found as one alternation finds them."""
    import re

    from pyspark.sql import functions as F

    from heron import rules
    from heron.functions import text as T

    names = [*rules.STATES, "New", "Kan", "A"]
    texts = ["In new \n york, KANSAS or west Virginia; virginia's WA", "Alabamax xAL AL", "ſouth Dakota, Kansas", "oklahoma ok", "newyork new mexico north\tdakota_ OHIO-IO", "", None, "A.AK é AL éAL"]
    plain = r"(?iU)\b(" + "|".join(n.replace(" ", r"\s+") for n in names) + r")\b"
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert T.one_of(names) != plain[5:] and re.search(r"\(\?=", T.one_of(names))
    for a, b in df.select(F.regexp_extract_all("text", F.lit(plain), F.lit(1)), F.regexp_extract_all("text", F.lit(f"(?iU){T.one_of(names)}"), F.lit(1))).collect():
        assert a == b
    assert T.one_of(["a.b", "c"]) == r"\b(a.b|c)\b"


def test_ngrams_without_pieces_of_arrays(spark, sf_dir):
    """An n-gram is made of its words, not of a slice for each; short, empty and null arrays have none."""
    from pyspark.sql import functions as F

    from heron.functions import text as T

    words = [list("abcab"), ["é", "b c", ""], ["x", "y"], ["x"], [], None]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>")
    for n in (1, 2, 3):
        want = [[" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if w else [] for w in words]
        assert [r[0] for r in df.select(T.ngrams(F.col("w"), n)).collect()] == want
    assert spark.range(1).select(T.similarity(F.lit(None).cast("string"), F.lit("a b c"))).first()[0] == 0.0
    assert "array_join(slice(" not in plan(spark, sf_dir, "text_similarity")


ODD = '<a href="/login">In</a><a href="/Customer/Login?x">driver</a><a>no place</a><a href="http://[bad">log in</a><form action="/quote"><input name="q"></form><form><input type="hidden"></form>'


def odd_pages(spark):
    return spark.createDataFrame([(1, "https://a.example/", ODD), (2, None, ODD), (3, "https://b.example/", None), (4, "", "<form><input type=password>")], "page_id long, url string, html string")


def test_portals_alone(spark, sf_dir):
    """Only the links are looked for, and they are those of the whole scan."""
    from heron.functions import records

    pages = odd_pages(spark)
    assert sorted(records.portal_rows(pages).collect()) == sorted(records.scans(pages).selectExpr("page_id", "inline(portal_links)").collect()) != []
    assert "endpoints" not in plan(spark, sf_dir, "html_portals")


def test_forms_alone(spark, sf_dir):
    """Only the forms are looked for, and they are those of the whole scan."""
    from heron.functions import records

    pages = odd_pages(spark)
    assert sorted(records.form_rows(pages).collect(), key=str) == sorted(records.scans(pages).selectExpr("page_id", "inline(forms)").collect(), key=str) != []
    assert "endpoints" not in plan(spark, sf_dir, "html_forms")
