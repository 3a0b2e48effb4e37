"""Near-duplicates, repeated strings and archives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heron.llm import minhash, repeats, warc
from heron.llm.components import components

DOCS = "doc_id long, text string"


def near_copies():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], r.choices(words, k=80)
    for i in range(120):  # a loose group around one text, with copies of copies
        mine = list(base)
        for _ in range(r.randint(0, 7)):
            mine[r.randrange(80)] = r.choice(words)
        rows.append((i + 10, " ".join(mine)))
        if i % 10 == 0:
            base = mine
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "few words"), (5, "FEW words"), (6, "few  words"), (7, " ".join(r.choices(words, k=40)))]
    rows += [(500 + i, rows[0][1].upper()) for i in range(5)] + [(500, rows[0][1].upper())]
    return rows


def components_of(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = (t or "").translate(fold).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("square", [512, 16])
def test_near_dedup(spark, monkeypatch, square):
    monkeypatch.setattr(minhash, "SQUARE", square)
    rows = near_copies()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], DOCS).selectExpr("*", "1 as n", "2 as comp")
    out = minhash.near_dedup(docs).collect()
    assert len(out) == len(rows) + 1
    want = components_of(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"]} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("few,salt", [(0, 1), (1000, 1000)])
def test_near_dedup_of_repeated_ids(spark, monkeypatch, few, salt):
    """Several texts under one id: each row is linked by its own text, on all ways of joining."""
    monkeypatch.setattr(minhash, "FEW_IDS", few)
    monkeypatch.setattr(minhash, "SALT_ROWS", salt)
    monkeypatch.setattr(minhash, "HEAVY_PARTS", 4 if few == 0 else 1000)
    rows = near_copies()
    ids = [i % 40 + 1 for i in range(len(rows))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows, strict=True)], DOCS)
    by_row = components_of(list(enumerate(t for _, t in rows)))
    lowest = {}
    for k, (_, top) in by_row.items():
        lowest[top] = min(lowest.get(top, ids[k]), ids[k])
    want = sorted((ids[k], n, lowest[top]) for k, (n, top) in by_row.items())
    got = minhash.near_dedup(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = sorted(str((r["doc_id"], r["text"])) for r in minhash.keep_first(docs).collect())
    assert kept == sorted(str((ids[k], t)) for k, (_, t) in enumerate(rows) if ids[k] == lowest[by_row[k][1]])


def test_words_whose_polynomials_meet(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2^64; very long texts are cut at blanks."""
    texts = []
    for n in (1024, 4096):
        for a, b in ("ab", "ba"):
            s = a
            while len(s) < n:
                s += s.translate(str.maketrans(a + b, b + a))
            texts.append(s)
    docs = spark.createDataFrame([*enumerate(texts, 1), (9, "long text of words " * 40000), (10, "LONG text of words " * 40000 + "end")], DOCS)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(docs).collect()}
    assert out == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 9: (4, 9), 10: (5, 9)}


def test_recall_at_the_threshold(spark):
    """Pairs of exactly 75 of 100 shingles are linked, pairs of 74 are not."""
    r = random.Random(8)
    rows, i = [], 1
    for k in range(300):
        # two texts share their first words: n shared shingles, m more on either side
        n, m = (75, 25) if k % 2 else (74, 26)
        words = [f"{k}_{j}" for j in range(n + 4)]
        long = words + [f"{k}x{j}" for j in range(m)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(long))]
        i += 2
    r.shuffle(rows)
    out = {x["doc_id"]: x["component_id"] for x in minhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    for k in range(300):
        first = 2 * k + 1
        assert (out[first + 1] == first) == bool(k % 2)


def test_near_dedup_of_nothing(spark):
    assert minhash.near_dedup(spark.createDataFrame([], DOCS)).count() == 0
    alone = spark.createDataFrame([(1, "only one text of a few words here")], DOCS)
    assert minhash.keep_first(alone).count() == 1


def test_keep_first_keeps_other_texts_of_one_id(spark):
    same, other = "one two three four five six", "quite another text of six words"
    docs = spark.createDataFrame([(1, same), (2, same), (2, other), (2, None), (None, same)], DOCS)
    got = {(r["doc_id"], r["text"]) for r in minhash.keep_first(docs).collect()}
    assert got == {(1, same), (2, other), (2, None), (None, same)}


def test_near_dedup_keeps_all_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "quite another text of six words"), (2, "one two three four five six"), (2, "one two three four five six")], DOCS)
    assert minhash.near_dedup(docs).count() == 4


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (4, 5), (5, 6), (2, 1)], "a long, b long")
    assert {r["doc"]: r["comp"] for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 8, 9: 8}


def brute_repeats(texts, keep):
    from collections import Counter

    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    met, out = set(), []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            w = b[i : i + 200]
            if (keep == "none" and seen[w] > 1) or (keep == "first" and w in met):
                gone[i : i + 200] = True
            met.add(w)
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes() if len(b) else b"")
    return out


@pytest.mark.parametrize("keep,together,few", [("none", 600, 9999), ("none", 3, 0), ("first", 600, 0), ("first", 3, 9999)])
def test_repeats(spark, monkeypatch, keep, together, few):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "FEW", few)
    r = random.Random(1)
    noise = lambda n: "".join(r.choices("abcdefgh é", k=n))
    line, passage = noise(150), noise(330)
    texts = [None, "", "short", passage, passage, "x" * 700] + [noise(120) + line + noise(90) for _ in range(12)]
    texts += [noise(50) + passage[r.randint(0, 60) :] + noise(70) for _ in range(8)] + [noise(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).selectExpr("*", "1 as lo", "'z' as bytes")
    out = {x["doc_id"]: bytes(x["kept"]) for x in repeats.remove_repeats(docs, keep).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts, keep)


def test_repeats_of_null_ids(spark):
    """Null ids are documents like others; of their equal texts no byte is left."""
    r = random.Random(7)
    passage, tail = "".join(r.choices("abcdefgh", k=260)), "".join(r.choices("xyz", k=250))
    docs = spark.createDataFrame([(None, passage), (None, passage + "end"), (None, tail), (None, None), (3, "start" + passage)], DOCS)
    assert sorted(bytes(x["kept"]).decode() for x in repeats.remove_repeats(docs).collect()) == sorted(["", "end", tail, "", "start"])
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_merged_ranges(spark):
    rows = [([(0, 200), (10, 210), (210, 300), (301, 500), (302, 400)],), ([(5, 205)],), ([],), ([(0, 900), (10, 20), (850, 1000)],)]
    got = spark.createDataFrame(rows, "r array<struct<s:int,e:int>>").coalesce(1).select(repeats._merged(F.col("r")).alias("m")).collect()
    assert [[tuple(x) for x in r["m"]] for r in got] == [[(0, 300), (301, 500)], [(5, 205)], [], [(0, 1000)]]


def test_repeats_in_pieces(spark, monkeypatch):
    from heron.llm import textcodec

    monkeypatch.setattr(repeats, "PIECE", 512)
    r = random.Random(3)
    body = "".join(r.choices("abcdef", k=3000))
    data = np.frombuffer((body + body[700:1200]).encode(), np.uint8)
    covered = set()
    for a in range(0, len(data) - 199, 512):
        _, lo, hi, *_ = repeats._runs(data[a : a + 512 + 199], np.array([0, len(data[a : a + 711])]))
        covered |= {a + s for x, y in zip(lo, hi, strict=True) for s in range(x, y + 1)}
    assert covered == set(range(len(data) - 199)) and textcodec.CHUNK > 0


def test_factors():
    text = b"banana bandana"
    order = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
    common = lambda i, j: next((k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), 0)
    lcp = np.array([0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)])
    got = dict(zip(order.tolist(), repeats.factors(order, lcp).tolist(), strict=True))
    assert got == {i: max((common(i, j) for j in range(i)), default=0) for i in range(len(text))}


PAGES = "page_id long, url string, html string"


def archived(spark, rows):
    return warc.read(spark, warc.write(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as node", "2 as hash")))


def kinds(spark, ours, theirs):
    return sorted((r["page_id"], r["kind"]) for r in warc.audit(*(warc.tree(archived(spark, x).leaves) for x in (ours, theirs))).collect() if r["kind"] != "moved")


def test_audit(spark):
    rows = [(i, f"http://a/{i}", f"<p>{'é' * (i % 50)}</p>") for i in range(2300)] + [(7, "again", ""), (8, "long", "long " * 200000)]
    assert kinds(spark, rows, rows) == []
    wrong = [(i, u, "<q>other</q>" if i == 1500 else h) for i, u, h in rows]
    assert kinds(spark, rows, wrong) == [(1500, "changed")]
    # a lost record moves all that follow it in its file, and is the only one that is missing
    assert kinds(spark, rows, [r for r in rows if r[0] != 1200]) == [(1200, "missing")]
    assert kinds(spark, [r for r in rows if r[0] != 1200], rows) == [(1200, "added")]
    two = kinds(spark, rows + [(None, None, None)], rows)
    assert two == [(None, "missing")]
    assert len(kinds(spark, rows[:20], [])) == 20 and kinds(spark, [], []) == []
    assert {k for _, k in kinds(spark, [], rows[:20])} == {"added"}


def test_archive_round_trip(spark, tmp_path):
    inner = warc.FIRST + "resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/1", "<p>one\r\n\r\n</p>"), (2, None, None), (3, "u", "é" * 300), (4, "v", "x" + inner + inner), (5, "w", "\r\n\r\n"), (None, "n", "null"), (1001, "z", "end")]
    got = archived(spark, rows).records.collect()
    made = {r["p"]: r["r"] for r in spark.createDataFrame(rows, PAGES).select(F.col("page_id").alias("p"), warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()}
    assert sorted(r["record"] for r in got) == sorted(made.values())
    order = [r["record"] for r in sorted((r for r in got if r["file"] == 0), key=lambda r: (r["at"]["block"], r["at"]["k"]))]
    assert order == [made[i] for i in range(1, 6)]
    again = warc.read(spark, warc.copy(archived(spark, rows).records))
    assert sorted(r["record"] for r in again.records.collect()) == sorted(made.values())
    folder = warc.write(spark.createDataFrame(rows, PAGES))
    bodies = warc.foreign(spark, f"{folder}/*/*.gz").collect()
    assert sorted(bytes(r["body"]).decode() for r in bodies) == sorted(h or "" for _, _, h in rows) and {r["kind"] for r in bodies} == {"resource"}


def test_parse_of_broken_archives():
    import gzip

    archive = b"".join(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n".encode() for b in ("one", "", "three\r\n\r\n"))
    back = list(warc.parse(archive))
    assert [b.decode() for *_, b in back] == ["one", "", "three\r\n\r\n"] and sum(n for _, n, *_ in back) == len(archive)
    broken = archive.replace(b"Content-Length: 3", b"Content-Length: x", 1)[:-3]
    assert [bool(f) for _, _, f, _ in warc.parse(broken)] == [False, True, False] and sum(n for _, n, *_ in warc.parse(broken)) == len(broken)
    members = gzip.compress(archive[:60]) + gzip.compress(archive[60:])
    assert warc.unzipped(members) == archive and warc.unzipped(archive) == archive
    assert warc.unzipped(gzip.compress(b"whole") + b"\x1f\x8b broken").startswith(b"whole") and list(warc.parse(b"")) == []
