"""Containers of bits, bucketed tables and the join of two streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from heron.functions import containers
from heron.sources.store import SiteStore
from heron.streaming import telemetry


@pytest.mark.parametrize("sparse,few", [(256, 200_000), (2, 200_000), (2, 0)])
def test_containers(spark, monkeypatch, sparse, few):
    monkeypatch.setattr(containers, "SPARSE", sparse)
    monkeypatch.setattr(containers, "FEW", few)
    r = random.Random(6)
    rows = [("all", p) for p in range(0, 70000, 7)] + [(r.choice(["a", None]), r.randint(-100000, 100000)) for _ in range(300)] + [("edge", p) for p in (-1, 0, 1, 32767, 32768, 32769, 65536)] * 2 + [("none", None)]
    held = containers.containers(spark.createDataFrame(rows, "k string, p long"), ["k"], "p")
    want = sorted({(str(k), p) for k, p in rows if p is not None})
    assert sorted((str(x["k"]), x["page"]) for x in containers.pages_of(held, ["k"]).collect()) == want
    sums = {str(x["k"]): (x["n"], x["first"]) for x in held.groupBy("k").agg(F.sum("n").alias("n"), F.min("first").alias("first")).collect()}
    assert sums == {k: (sum(a == k for a, _ in want), min(p for a, p in want if a == k)) for k, _ in want}
    assert held.filter("k = 'all' and bits is not null").count() == 3


def test_store_joins_without_exchange(spark, capsys):
    store = SiteStore(spark, buckets=4)
    pages = store.write("pages", spark.range(1000).selectExpr("concat('d', id % 30) as domain", "id as page"))
    seeds = store.write("seeds", spark.range(30).selectExpr("concat('d', id) as domain", "id % 3 as tier"))
    out = seeds.hint("merge").join(pages.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "domain")
    out.explain()
    assert "Exchange" not in (plan := capsys.readouterr().out) and "SortMergeJoin" in plan
    assert sorted((x["domain"], x["n"]) for x in out.collect()) == sorted((f"d{k}", 34 if k < 10 else 33) for k in range(30))
    store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.endswith(store.id)]


def test_freshness(spark, tmp_path):
    """Early, late and missing crawls; what is held goes once the watermarks have passed."""
    t0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    at = lambda h: t0 + datetime.timedelta(hours=h)
    due = [[(1, 1, at(30)), (2, 2, at(30)), (3, 3, at(30)), (None, 4, at(30))], [(1, 5, at(100)), (9, 6, at(300))], [(-1, -1, at(9999))]]
    crawls = [[(1, at(6.5)), (1, at(29)), (2, at(6)), (3, at(31))], [(1, at(99)), (9, at(270))], [(1, at(25)), (-1, at(9999))]]
    for n in range(3):
        spark.createDataFrame(due[n], "user_id long, event_id long, due_at timestamp").coalesce(1).write.parquet(str(tmp_path / f"due/n={n}"))
        spark.createDataFrame(crawls[n], "user_id long, crawled_at timestamp").coalesce(1).write.parquet(str(tmp_path / f"crawls/n={n}"))
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}/n=*"))
    out = telemetry.freshness(stream("due", "user_id long, event_id long, due_at timestamp"), stream("crawls", "user_id long, crawled_at timestamp"), "1 day", "2 hours")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((x["event_id"], x["crawled_at"].timestamp() if x["crawled_at"] else None) for x in spark.read.parquet(str(tmp_path / "out")).collect() if x["event_id"] > 0)
    hours = lambda *hs: [at(h).timestamp() for h in hs]
    # the crawl at hour 25 comes when its visit has long left the state
    assert got == [*((1, x) for x in hours(6.5, 29)), (2, None), (3, None), (4, None), (5, *hours(99)), (6, None)]
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] <= 2 < max(held)
