"""Exact dedup, chat formatting and decontamination on small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from heron.llm import chat, decontaminate, exact_dedup

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows, a long text and columns with clashing names."""
    long = "long " * 30000
    rows = [(1, None), (2, ""), (3, "Same Text"), (4, "sAME tEXT"), (5, "ÉTÉ"), (6, "été"), (7, long), (8, long.upper()), (9, "x"), (9, "x"), (None, "y"), (None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"n": F.lit(1), "cnt": F.lit(2), "fp": F.lit("z"), "name": F.lit("q")})


def brute(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(fold), []).append(i)
    return groups


@pytest.mark.parametrize("block,fingerprint,few", [(4096, F.xxhash64, 100), (3, F.xxhash64, 0), (2, lambda b: F.length(b).cast("long"), 100), (2, lambda b: F.length(b).cast("long"), 0)])
def test_exact_dedup(spark, odd, monkeypatch, block, fingerprint, few):
    monkeypatch.setattr(exact_dedup, "FEW_PRINTS", few)
    monkeypatch.setattr(exact_dedup, "ROWS", 1)
    docs = odd if block > 100 else odd.filter("length(text) < 100 or text is null")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = exact_dedup.exact_dedup(docs, block, fingerprint).collect()
    assert len(out) == len(rows)
    for t, ids in brute(rows).items():
        mine = [r for r in out if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert len(mine) == len(ids) and {r["group_size"] for r in mine} == {len(ids)}
        assert {r["keep_id"] for r in mine} == {max(known) if known else None}
        assert sum(r["kept"] for r in mine) == 1


@pytest.mark.parametrize("few", [100, 0])
def test_exact_dedup_keeps_rows(spark, odd, monkeypatch, few):
    monkeypatch.setattr(exact_dedup, "FEW_ROWS", few)
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 4, 5, 6, 8, 9]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(spark.createDataFrame([(1, "a b")], DOCS), items.limit(0)).first()["contaminated"] is False
    assert chat.read_back(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_decontamination(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    items = spark.createDataFrame([(1, words), (2, "one two"), (3, None), (4, "--"), (10, "one TWO")], "item_id long, text string")
    docs = [(1, f"x {words.upper()} y"), (2, "charlie delta echo foxtrot golf hotel india juliet kilo lima!"), (3, "bravo charlie delta echo foxtrot golf hotel india juliet"), (4, "one, two one two"), (5, None), (6, "the the the"), (4, "one, two one two")]
    out = {r["doc_id"]: r for r in decontaminate.contamination(spark.createDataFrame(docs, DOCS), items).collect()}
    got = {i: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for i, r in out.items()}
    assert got[1] == (14, 12, ["1"], True) and got[2] == (10, 10, ["1"], True) and got[3] == (9, 0, [], False)
    assert got[4] == (4, 4, ["10", "2"], True) and got[5] == (0, 0, [], False) and got[6] == (3, 0, [], False)
    assert decontaminate.clean(spark.createDataFrame(docs, DOCS), items).count() == 3


def test_decontamination_of_odd_rows(spark):
    """Null ids, repeated rows, long texts and columns with clashing names."""
    items = spark.createDataFrame([(1, "one two"), (None, "long end"), (1, "one two")], "item_id long, text string").selectExpr("*", "1 as window", "2 as w")
    rows = [(None, "one two"), (None, "clean"), (2, "one two"), (2, "one two"), (3, "long " * 60000 + "end"), (4, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as pos", "2 as term", "3 as n", "4 as d", "5 as k", "6 as start")
    out = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect())
    assert out == [("2", 2, 2, ["1"], True), ("2", 2, 2, ["1"], True), ("3", 60001, 2, [], True), ("4", 0, 0, [], False), ("None", 1, 0, [], False), ("None", 2, 2, ["1"], True)]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "None"]


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_decontamination_by_either_join(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW", few)
    test_decontamination_of_odd_rows(spark)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "rare words stand near")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "rare x x words stand near"), (2, "rare " + "x " * 50 + "words"), (3, "near stand words rare")], DOCS)
    found = decontaminate.proximity_matches(docs, decontaminate.test_windows(items).select("window", "w").distinct(), 5)
    assert 2 not in {r["doc_id"] for r in found.collect()} and {r["doc_id"] for r in found.collect()} >= {1, 3}


def test_proximity_of_changed_and_repeated_words(spark):
    items = spark.createDataFrame([(1, "rare words unseen near"), (2, "odd odd even")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "rare words changed near near"), (2, "even x odd odd even even"), (3, "near " + "x " * 50 + "rare")], DOCS)
    found = decontaminate.proximity_matches(docs, decontaminate.test_windows(items).select("window", "w").distinct(), 5)
    assert {(r["doc_id"], r["window"]) for r in found.collect()} == {(1, "rare words unseen near"), (2, "odd odd even")}


def test_clean_keeps_other_texts_of_one_id(spark):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "one two"), (None, "clean"), (1, "so one two"), (1, "clean too"), (1, None)], DOCS)
    assert sorted(str(r["text"]) for r in decontaminate.clean(docs, items).collect()) == ["None", "clean", "clean too"]


def test_chat_windows(spark):
    said = "</s>[INST] ok ~0 <h>[x] ] [/INST]"
    turns = [(1, 0, "system", "be good"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "user", None), (1, 4, "assistant", "w " * 900), (1, 5, "user", "again"), (1, 6, "assistant", "yes"), (2, 0, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 0, "user", "n")]
    made = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert back[1]["n_turns"] == 7 and back[1]["loss"] == said + "w " * 900 + "yes"
    assert back[1]["turns"] == "".join(f"{r}\n{t or ''}\n" for c, _, r, t in turns if c == 1)
    assert back[2]["turns"] == "\n\n" and back[3]["loss"] == "aab" and back[None]["n_turns"] == 1
    held = [r for r in made.collect() if r["conv_id"] == 1]
    assert len(held) > 1 and all("be good" in r["text"] for r in held)
    again = [r for r in chat.read_turns(made).collect() if r["again"]]
    assert again and all(r["window"] > 0 for r in again)


def test_chat_of_odd_rows(spark):
    """Columns with clashing names, and a turn longer than many windows."""
    long = "word " * 50000
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", long), (1, 2, "assistant", "end"), (1, 2, "assistant", "end")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as pos", "3 as tokens", "4 as mask", "5 as head")
    back = chat.read_back(chat.windows(rows)).first()
    assert back["n_turns"] == 4 and back["loss"] == long + "endend"


def test_stored_tables_are_deleted(spark, tmp_path):
    import os

    from heron.llm import common

    point, before = common.mark(), spark.conf.get(common.BATCH)
    a, b, c = (common.stored(spark.range(3), n) for n in "abc")
    places = [t._heron_path for t in (a, b, c)]
    assert spark.conf.get(common.BATCH) == before
    common.discard(a)
    common.discard_since(spark, point, keep=c)
    assert [os.path.exists(p) for p in places] == [False, False, True] and common.mark() == point + 1
    assert c.count() == 3
    common.discard_since(spark, point)
    assert not os.path.exists(places[2]) and common.mark() == point
