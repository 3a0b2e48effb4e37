"""Toxicity, quality, personal data and BPE: held-out accuracy, round trips, reference patterns."""

import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from heron.llm import bpe, pii, quality, toxicity

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "you idiot"), (4, "word " * 200000), (5, "\x00́é 🙂")]
SF = "/root/testdata/sf0.1"


def folds(label):
    rows = duckdb.connect().execute(f"select text, {label}, doc_id from '{SF}/documents.parquet' join '{SF}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    out = lambda r: zlib.crc32(str(r[2]).encode()) % 5 == 0
    return [r[:2] for r in rows if not out(r)], [r[:2] for r in rows if out(r)]


def test_toxicity_held_out():
    train, test = folds("toxic")
    model = toxicity.learn(train)
    right = sum((model.score(t) >= 0.5) == bool(y) for t, y in test)
    caught = sum(model.score(t) >= 0.5 for t, y in test if y)
    assert right / len(test) > 0.97 and caught / sum(y for _, y in test) > 0.85


def test_toxicity_grammar():
    model = toxicity.learn([])
    plain, aimed, negated, reported = (model.clause_score(c) for c in ("what an idiot", "you idiot", "you are not an idiot", "he said you idiot"))
    assert aimed > plain > negated > 0 and reported < aimed
    assert model.score("the weather is fine") < 0.5 and model.clauses("") == (0.0, 0)


def test_composed_grammar_is_its_parts_in_turn():
    aimed, machine = toxicity.aiming(), toxicity.grammar()
    r = random.Random(3)
    for _ in range(500):
        symbols = r.choices(toxicity.ALPHABET, k=r.randint(0, 12))
        state, one = 0, []
        for x in symbols:
            state, out = machine.step(state, x)
            one.append(out)
        # plainly: a target before aims, a negation weakens within its scope, a report to the end
        state, want, scope, told = 0, [], 0, False
        for x in symbols:
            state, out = aimed.step(state, x)
            scope = toxicity.SCOPE if out == toxicity.NEGATION else scope
            weak = out in toxicity.WEAK and (scope > 0 or told)
            if out in (toxicity.OTHER, toxicity.TARGET, toxicity.REPORT):
                scope = max(0, scope - 1)
            told = told or out == toxicity.REPORT
            want.append(toxicity.WEAK[out] if weak else out)
        assert one == want, symbols
    model = toxicity.learn([])
    assert model.clause_score("idiot, you are") == model.clause_score("you idiot")


def test_viterbi_is_the_best_of_all_paths():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    k = len(pii.TAGS)
    crf = pii.Crf(r.normal(size=(pii.BUCKETS, k)), r.normal(size=(k, k)))
    words = [["a", "12"], ["x@y"], ["call", "(415)", "5"]]
    for run, got in zip(words, crf.decode(words), strict=True):
        s = crf.emit[pii.features(run)].sum(1)
        total = lambda path: sum(s[t, y] for t, y in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:], strict=False))
        assert total(got) == pytest.approx(max(total(p) for p in itertools.product(range(k), repeat=len(run))))


def test_shapes_are_of_whole_words():
    assert pii.shape("a" * 50 + "1") != pii.shape("a" * 50 + "@") and pii.shape("1" * 100 + "x") != pii.shape("1" * 100 + "-")


def test_quality_held_out():
    train, test = folds("quality")
    model = quality.learn(train)
    s = model.score(pa.array([t for t, _ in test]))
    assert sum((a >= 0.3) == bool(y) for a, (_, y) in zip(s, test, strict=True)) / len(test) > 0.97


def test_quality_of_a_text_does_not_hang_on_its_neighbours():
    texts = ["a b a b a", "word", "", " \t ", "x\x0by " * 300, "ends blank ", "the cat the cat " * 80 + "end", "é" * 400]
    alone = [x for t in texts for x, _ in quality.passages(pa.array([t], pa.large_string()))]
    [(among, first)] = quality.passages(pa.array(texts, pa.large_string()))
    assert [len(x) for x in alone] == [b - a for a, b in zip(first[:-1], first[1:], strict=True)]
    assert all((a == b).all() for a, b in zip((r for x in alone for r in x), among, strict=True))
    assert abs(among[0, quality.CLASSES] - 0.6) < 1e-6 and among[1, quality.CLASSES] == 0
    model = quality.learn([(t, i % 2) for i, t in enumerate(texts)])
    assert all(abs(model.score(pa.array([t]))[0] - s) < 1e-9 for t, s in zip(texts, model.score(pa.array(texts)), strict=True))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, module):
    docs = spark.createDataFrame(ODD, DOCS).selectExpr("*", "'x' as score", "1 as held_out")
    labels = spark.createDataFrame([(3, 1, 1), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    out = module.scores(docs, module.fit(docs, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert module.scores(docs.limit(0), module.fit(docs.limit(0), labels.limit(0))).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plainly(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_are_those_of_the_patterns():
    r, parts = random.Random(5), ["a", "b.", "@", "@", "x-y", ".com", ".", "1", "255", "256", "007", " ", "-", "+", "(", ")", "4111", "1111", "+1", "٣", "é"]
    for _ in range(5000):
        t = "".join(r.choices(parts, k=r.randint(0, 25)))
        assert sorted(plainly(t)) == sorted(pii.base_spans(t))


def test_base_spans_in_linear_time():
    for t in ("1" * 500000, "a" * 500000 + "@", "@" * 100000, "+1" * 100000, "1.1.1." * 50000):
        pii.base_spans(t)
        pii.sequences(t)


def test_crf_adds_spans(spark):
    texts = ["call (415) 555-0132 after six", "mail me : j.doe [at] example [dot] org thanks", "the year 2019 was warm", "me@a.org"]
    added = pii.added_spans(texts, [pii.base_spans(t) for t in texts], pii.trained())
    assert [k for k, _, _ in added[0]] == ["phone"] and [k for k, _, _ in added[1]] == ["email"] and added[2] == [] and added[3] == []
    docs = spark.createDataFrame([*ODD, (9, "to me@a.org")], DOCS)
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in found[9]["base"]] == [("email", 3, 11)] and found[1]["base"] == []
    assert {r["doc_id"]: r["clean"] for r in pii.masked(docs.filter("doc_id = 9")).collect()} == {9: "to [email]"}


@pytest.fixture(scope="module")
def tokenizers_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_is_the_library(tokenizers_path):
    from tokenizers import Tokenizer

    own, codec, r = Tokenizer.from_file(tokenizers_path), bpe.Codec(tokenizers_path), random.Random(2)
    parts = [*"abcdeehilnorstthe  '!?.,0123ABCDÉéßñÇ½³²\n\t\x1c\x85\xa0　中文🙂́İΣσςǅ\x00", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "</w>", "inging", "tion"]
    for _ in range(4000):
        t = "".join(r.choices(parts, k=r.randint(0, 40)))
        ids = own.encode(t, add_special_tokens=False).ids
        assert codec.encode(t) == ids and codec.decode(ids) == own.decode(ids, skip_special_tokens=False)
    long = "ab" * 50000
    assert codec.encode(long) == own.encode(long, add_special_tokens=False).ids


def test_bpe_rows(spark, tokenizers_path):
    docs = spark.createDataFrame(ODD, DOCS).selectExpr("*", "2 as n_tokens")
    out = bpe.decode(bpe.encode(docs, tokenizers_path), tokenizers_path).collect()
    assert len(out) == len(ODD) and [r["tokens"] for r in out if not r["text"]] == [[], []]
    assert bpe.digests(docs.limit(0), tokenizers_path).count() == 0


def test_crf_tags_every_word():
    """Also where no digit or at sign is near, and like the plain decoder over parts of a long text."""
    import numpy as np

    crf = pii.trained()
    texts = ["write to anna.lee at example dot com today", "the shop is open. At noon, they rest", "so it goes " * 3000 + "write to anna.lee at example dot com today"]
    added = pii.added_spans(texts, [[], [], []], crf)
    assert [texts[0][a:b] for _, a, b in added[0]] == ["anna.lee at example dot com"] and added[1] == []
    assert [(k, texts[2][a:b]) for k, a, b in added[2]] == [("email", "anna.lee at example dot com")]
    r = np.random.default_rng(3)
    words = [str(w) for w in r.choice(["call", "(415)", "5", "x@y", "me", "at", "dot", "the"], 10000)]
    parts, whole = crf.decode([words])[0], crf._decode([words])[0]
    assert len(parts) == len(words) and np.array_equal(parts, whole)
