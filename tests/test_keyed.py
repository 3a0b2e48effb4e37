"""The stored queue: merges, replays, removal, next, clear."""

import datetime

import pytest
from pyspark.sql import functions as F

from heron.streaming.keyed import KeyedTable, into
from heron.streaming.work import WorkQueue

FAILED = "domain string, at timestamp, reason string, tried array<string>, tier int"
DONE = "domain string, completed timestamp, pages long, words long"


def at(n):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=n)


@pytest.fixture
def queue(spark, tmp_path):
    q = WorkQueue(spark, str(tmp_path), buckets=4)
    q.failed = lambda *rows: spark.createDataFrame(rows, FAILED)
    q.done = lambda *rows: spark.createDataFrame(rows, DONE)
    q.now = lambda: {r["domain"]: (r["again"], r["reason"], r["tried"], r["priority"], r["tier"]) for r in q.listed().collect()}
    return q


def test_add_merges(queue):
    queue.add(queue.failed(("a", at(1), "blocked", ["js"], 1), ("b", at(2), "empty", None, None), ("a", at(3), "timeout", ["plain", "js"], 2)), batch=0)
    want = {"a": (1, "timeout", ["js", "plain"], "high", 1), "b": (0, "empty", [], "normal", None)}
    assert queue.now() == want
    queue.add(queue.failed(("a", at(9), "again", ["x"], 1)), batch=0)  # the same batch once more
    assert queue.now() == want
    queue.add(queue.failed(("a", at(5), "later", ["visible"], 3), (None, at(6), "nameless", None, None)), batch=1)
    assert queue.now() == want | {"a": (2, "later", ["js", "plain", "visible"], "high", 1), None: (0, "nameless", [], "normal", None)}


def test_next_is_by_rank_then_age(queue):
    assert queue.next() is None
    queue.add(queue.failed(("old", at(0), "r", None, 2), ("new", at(8), "r", None, 1), ("newer", at(9), "r", None, 1)))
    assert queue.next()["domain"] == "new"
    queue.remove(queue.done(("new", at(10), 5, 100)))
    assert queue.next()["domain"] == "newer"


def test_remove_logs_once(queue):
    queue.add(queue.failed(("a", at(0), "r", None, 1), ("b", at(0), "r", None, 1)))
    for _ in range(2):
        queue.remove(queue.done(("a", at(1), 5, 100), ("unknown", at(2), 1, 1)), batch=7)
    assert set(queue.now()) == {"b"}
    assert sorted(r["domain"] for r in queue.completed.read().collect()) == ["a", "unknown"]
    for n in (8, 9):
        queue.remove(queue.done(("a", at(n), 1, 1)), batch=n)
    assert [tuple(r) for r in queue.perpetual(at(24)).collect()] == [("a", 3)]
    assert queue.perpetual(at(24 * 90 + 8)).collect() == []


def test_clear_and_vacuum(queue):
    queue.add(queue.failed(*((f"d{k}", at(k), "r", None, 2) for k in range(30))))
    before = queue.listed()
    assert queue.clear() == 30 and queue.now() == {} and queue.next() is None
    assert before.count() == 30  # the version that a reader holds is still there
    assert queue.entries.vacuum() > 0
    queue.add(queue.failed(("d1", at(50), "r", None, 2)))
    assert queue.now() == {"d1": (0, "r", [], "normal", 2)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k long, v long", ["k"], 16)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))
    t.merge(spark.range(500).selectExpr("id as k", "1L as v"), add)
    first = t.state()["buckets"]
    t.merge(spark.createDataFrame([(7, 5)], "k long, v long"), add)
    second = t.state()["buckets"]
    assert len(first) == 16 and sum(first[b] != second[b] for b in first) == 1
    assert t.read().agg(F.sum("v"), F.count("k")).first() == (505, 500)
    assert t.merge(spark.createDataFrame([], "k long, v long"), add, "w", 3) == 3 and t.state()["batches"] == {"w": 3}


def test_stream_survives_a_lost_checkpoint(spark, tmp_path):
    """The stream starts anew from its first batch; the table has counted it already."""
    t = KeyedTable(spark, str(tmp_path / "t"), "k long, v long", ["k"], 4)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))
    spark.range(100).selectExpr("id % 10 as k", "1L as v").coalesce(1).write.parquet(str(tmp_path / "in"))
    for attempt in range(2):
        into(spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in")), t, add, str(tmp_path / f"state{attempt}"), "w")
        assert sorted(tuple(r) for r in t.read().collect()) == [(k, 10) for k in range(10)]


def test_a_second_writer_is_told(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k long", ["k"], 2)
    t.merge(spark.range(3).selectExpr("id as k"), lambda old, new: new)
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit({"version": 1, "buckets": {}, "batches": {}})
    assert t.read().count() == 3
