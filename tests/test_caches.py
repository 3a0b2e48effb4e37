"""Stream caches that forget: answers, and that expired keys leave the state."""

import datetime

import pytest

from heron.streaming import caches

DAYS = 18
SCHEMA = "user_id long, event_id long, event_type string, value double, ts timestamp"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(days):
    return T0 + datetime.timedelta(days=days)


def plain_strategies(rows, ttl):
    held, out = {}, {}
    for user, event, kind, value, ts in sorted(rows, key=lambda r: (r[4], r[1])):
        e = held.get(user)
        if e and ts - e[2] > ttl:
            e = None
        out[event] = (e[0], e[1], e[0] is not None) if e else (None, None, False)
        good = value is not None and value >= 30
        held[user] = (kind if good else e[0] if e else None, kind if not good else e[1] if e else None, ts)
    return out


def plain_probes(rows, ttl, error_ttl):
    held, out = {}, {}
    for user, event, _, value, ts in sorted(rows, key=lambda r: (r[4], r[1])):
        e = held.get(user)
        fresh = e and ts - e[0] < (error_ttl if e[1] else ttl)
        if not fresh:
            e = held[user] = ts, value is None or value < 20
        out[event] = not fresh, int((e[0] - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) / datetime.timedelta(microseconds=1))
    return out


def plain_runs(rows, ttl):
    held, out = {}, {}
    for user, event, _, value, ts in sorted(rows, key=lambda r: (r[4], r[1])):
        run, at_ = held.get(user, (0, ts))
        run = 0 if ts - at_ > ttl else run
        run = 0 if value is not None and value >= 30 else run + 1
        held[user] = run, ts
        out[event] = run, run >= 2
    return out


def streamed(spark, tmp_path, rows, make):
    """Runs rows, a file a day, in order; the result, and how many keys the state held after each batch."""
    own = caches.session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    for day in range(DAYS):
        part = [r for r in rows if int((r[4] - T0).total_seconds() // 86400) == day]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/day={day:02d}"))
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/day=*"))
    query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.parquet(str(tmp_path / "out")).collect(), held


def visits():
    """A hundred and fifty domains, each seen on two days, some once more after a week."""
    rows = []
    for user in range(150):
        first = user % (DAYS - 3)
        for k, day in enumerate([first, first + 0.5, first + 2.25, *([first + 7.0] if first < 10 and user % 3 == 0 else [])]):
            rows.append((user, len(rows), ["js", "plain", "visible"][(user + k) % 3], None if user % 17 == 0 else float((user * 7 + k * 13) % 60), at(day)))
    return rows


@pytest.mark.parametrize("kind", ["strategies", "probes", "runs"])
def test_cache(spark, tmp_path, kind):
    rows, day = visits(), datetime.timedelta(days=1)
    if kind == "strategies":
        out, held = streamed(spark, tmp_path, rows, lambda s: caches.strategy_lookups(s, 2 * caches.DAY, late="1 hour"))
        assert {r["event_id"]: (r["cached"], r["failed"], r["hit"]) for r in out} == plain_strategies(rows, 2 * day)
    elif kind == "runs":
        out, held = streamed(spark, tmp_path, rows, lambda s: caches.failure_runs(s, 2 * caches.DAY, late="1 hour"))
        assert {r["event_id"]: (r["failures"], r["requeue"]) for r in out} == plain_runs(rows, 2 * day)
    else:
        out, held = streamed(spark, tmp_path, rows, lambda s: caches.probe_lookups(s, 3 * caches.DAY, caches.DAY, late="1 hour"))
        assert {r["event_id"]: (r["fetched"], r["fetched_at"]) for r in out} == plain_probes(rows, 3 * day, day)
    assert len(out) == len(rows)
    assert max(held) < 120  # entries and timers of the keys of a few days, not of a hundred and fifty
    assert held[-1] < max(held)
