"""Readers, writers, profiles, plans and flows on small files and cases."""

import json

import pytest
from pyspark.sql import functions as F

from heron.functions import flows, policy
from heron.sources import readers, sinks


def test_seeds_and_companies(spark, tmp_path):
    (tmp_path / "seeds.json").write_text(json.dumps({"carriers": [{"name": "A", "domain": "a.com", "category": ["ltl"], "tier": 1}, {"name": "B", "domain": "b.com", "tier": 2}]}))
    assert [(r["domain"], r["category"], r["tier"]) for r in readers.seeds(spark, str(tmp_path / "seeds.json")).collect()] == [("a.com", ["ltl"], 1), ("b.com", None, 2)]
    (tmp_path / "list.json").write_text(json.dumps([{"domain": "c.com", "category": "otr"}]))
    assert readers.companies(spark, str(tmp_path / "list.json")).first()["category"] == ["otr"]
    (tmp_path / "odd.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        readers.companies(spark, str(tmp_path / "odd.json"))


def test_settings_and_profiles(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "empty.json").write_text("")
    assert readers.settings(spark, str(tmp_path / "empty.json")) == {}
    folder = tmp_path / "profiles"
    folder.mkdir()
    (folder / "generic.yaml").write_text(yaml.safe_dump({"name": "generic", "priority": {"high": ["/product"]}, "settings": {"max_pages": 50}}))
    (folder / "cars.yaml").write_text(yaml.safe_dump({"priority": {"low": ["("]}, "products": [{"name": "van", "patterns": ["/van"], "terms": ["van", "load"]}, "odd"], "expected_nav_sections": ["cars"], "features_of_interest": ["login"]}))
    assert readers.profile_names(spark, str(folder)) == ["cars", "generic"]
    cars = readers.profile(spark, str(folder), "cars")
    assert cars.name == "cars" and cars.priorities == {"low": ["\\("]} and cars.products == [("van", ["/van"], ["van", "load"])] and cars.max_pages == 100
    assert readers.profile(spark, str(folder), "none").max_pages == 50
    assert readers.profile_of({}) == readers.Profile()


def test_playbooks_and_flows(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"a.com": {"max_strategy": "js", "delay": 2}, "odd": "x"}))
    assert [(r["domain"], r["max_strategy"]) for r in readers.playbooks(spark, str(tmp_path / "p.json")).collect()] == [("a.com", "js")]
    (tmp_path / "f.json").write_text(json.dumps({"domain": "a.com", "actions": [{"action": "click", "x": 1, "y": 2}]}))
    assert readers.flows(spark, str(tmp_path / "f.json")).first()["actions"][0]["x"] == 1.0


def test_site_of(spark):
    found = spark.createDataFrame([("acme_com.json", 1), ("acme_com_summary.json", 2), ("beta_org_x.json", 3)], "file string, n int")
    seeds = spark.createDataFrame([("acme.com",), ("beta.net",), ("none.com",), ("",)], "domain string")
    assert {r["domain"]: r["site"] and r["site"]["n"] for r in readers.site_of(found, seeds).collect()} == {"acme.com": 1, "beta.net": 3, "none.com": None, "": None}


def test_main_text(spark):
    rows = spark.createDataFrame([(("full", None),), ((None, None),), (("full", "main"),)], "p struct<full_text:string,main_content:string>")
    assert [r[0] for r in rows.select(readers.main_text(F.col("p"))).collect()] == ["full", "", "main"]


def test_export_and_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t" * 200, ["a"], None), (2, "u", [], None)], "id int, title string, links array<string>, extra map<string,int>")
    sinks.export_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.export_csv(rows, str(tmp_path / "c"))
    back = {r["id"]: r for r in spark.read.option("header", True).schema("id int, title string, has_links boolean, extra string").csv(str(tmp_path / "c")).collect()}
    assert len(back[1]["title"]) == 100 and back[1]["has_links"] and not back[2]["has_links"]
    sinks.append_log(rows.select("id"), str(tmp_path / "l"))
    sinks.append_log(rows.select("id"), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4


def plan(spark, **layers):
    held = [F.create_map(*(F.lit(x) for kv in layers[k].items() for x in kv)) if layers.get(k) else F.lit(None).cast("map<string,string>") for k in ("playbook", "spec", "recon", "over")]
    return spark.range(1).select(policy.access_plan(*held).alias("p")).first()["p"].asDict()


def test_plans(spark):
    usual = {"initial_strategy": "requests", "max_attempts": 3, "max_escalations": 3, "patient_mode": False, "delay_seconds": 3.0, "allow_stealth": True, "allow_visible": False}
    assert plan(spark) == usual
    assert plan(spark, recon={"js_required": "true"}) == usual | {"initial_strategy": "js"}
    assert plan(spark, recon={"challenge_detected": "true", "waf": "cloudflare"}) == usual | {"initial_strategy": "stealth", "patient_mode": True}
    assert plan(spark, playbook={"strategy": "stealth", "delay": "5.0", "patient": "true"}) == usual | {"initial_strategy": "stealth", "delay_seconds": 5.0, "patient_mode": True}
    assert plan(spark, playbook={"strategy": "js", "delay": "3"}, spec={"method": "stealth", "delay": "10"}) == usual | {"initial_strategy": "stealth", "delay_seconds": 10.0}
    assert plan(spark, over={"access_max_attempts": "5"}) == usual | {"max_attempts": 5}
    assert plan(spark, over={"access_escalation_mode": "static"}) == usual | {"max_escalations": 0}
    assert plan(spark, playbook={"strategy": "manual"}) == usual | {"initial_strategy": "visible", "allow_visible": True}
    assert plan(spark, playbook={"strategy": "js"}, recon={"waf": "x"}) == usual | {"initial_strategy": "js"}
    assert plan(spark, playbook={"patient": "true"}, spec={"patient_on_block": "false"}) == usual


def test_merged_layers(spark):
    m = lambda **kv: F.create_map(*(F.lit(x).cast("string") for k, v in kv.items() for x in (k, v)))
    got = spark.range(1).select(policy.merged(m(a="1", b="1"), F.lit(None).cast("map<string,string>"), m(a=None, b="2", c=None)).alias("m")).first()["m"]
    assert got == {"a": "1", "b": "2"}


def test_differences_of_flows():
    a = [("navigate:/a", 1.0, "/a"), ("click:1", 1.0, None), ("type:x", 2.0, None), ("scroll:down:3", 0.0, None)]
    b = [("navigate:/b", 1.0, "/b"), ("click:1", 3.0, None), ("type:x", 2.2, None), ("click:9", 1.0, None), ("click:8", 1.0, None)]
    d = flows.difference(a, b)
    assert (d["matching"], d["replaced"], d["added"], d["removed"], d["timing"]) == (2, [0, 3], [4], [], [1])
    assert d["urls_added"] == ["/b"] and d["urls_removed"] == ["/a"] and d["timing_diff"] == 4.2 and d["similarity"] == pytest.approx(4 / 9)
    assert flows.difference(a, a)["similarity"] == 1.0 and flows.difference([], [])["matching"] == 0
    assert flows.difference(a, a[:2])["removed"] == [2, 3]


def test_signatures(spark):
    none = {"url": None, "selector": None, "text": None, "label": None, "direction": None, "amount": None, "x": None, "y": None, "delay": None}
    cases = [({"action": "navigate", "url": "/a"}, "navigate:/a"), ({"action": "click", "x": 76.0, "y": 25.0, "selector": "s" * 40, "label": "l" * 30}, f"click:(100,0):{'s' * 30}:{'l' * 20}"), ({"action": "click"}, "click:(0,0)::"), ({"action": "scroll", "direction": "up", "amount": 3}, "scroll:up:3"), ({"action": "type", "text": "hi"}, "type:hi"), ({"action": "wait"}, "wait")]
    rows = spark.createDataFrame([(none | c,) for c, _ in cases], f"a {flows.ACTION}")
    assert [r[0] for r in rows.select(flows.signature(F.col("a"))).collect()] == [want for _, want in cases]


def test_fixtures(spark, tmp_path):
    good = {"domain": "a.com", "total_word_count": 500, "access": {"strategy": "http", "blocked": False, "escalations": ["http->js"], "block_signals": []}, "pages": [{"url": "/"}, {"url": "/x"}]}
    bad = {"domain": "b.com", "total_word_count": 45, "access": {"strategy": "js", "blocked": True, "block_signals": ["cloudflare_challenge"]}, "pages": [{"url": "/"}]}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    cases = [
        ("ok", "good.json", {"success": True, "blocked": False, "strategy": "http", "pages_gt": 1, "words_gt": 100, "escalations": ["http->js"]}, []),
        ("held", "bad.json", {"success": False, "blocked": True, "words_lt": 100, "block_reason": "cloudflare"}, []),
        ("off", "bad.json", {"success": True, "blocked": False, "strategy": "http", "pages_gt": 1, "words_gt": 100, "escalations": ["x"], "block_reason": "akamai"}, ["success", "blocked", "strategy", "pages_gt", "words_gt", "escalations", "block_reason"]),
        ("lost", "none.json", {"success": False, "strategy": "js"}, ["strategy"]),
    ]
    (tmp_path / "manifest.json").write_text(json.dumps({"fixtures": [{"id": i, "crawl_file": f, "expected": e} for i, f, e, _ in cases]}))
    got = {r["id"]: r["failures"] for r in readers.fixture_failures(readers.fixtures(spark, str(tmp_path))).collect()}
    assert got == {i: want for i, _, _, want in cases}
