"""The pipeline against a plain one, stage by stage on the same rows."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from heron.llm import toxicity
from tests.llm.test_groups import components_of

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_pipeline_is_the_plain_one(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    con = duckdb.connect()
    rows = con.execute(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()
    rows = [(i, t or "") for i, t in rows if model.score(t or "") < 0.5]
    last = {}
    for i, t in rows:
        last[t.translate(FOLD)] = max(i, last.get(t.translate(FOLD), i))
    rows = [(i, t) for i, t in rows if last[t.translate(FOLD)] == i]
    near = components_of(rows)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    grams = set()
    for (t,) in con.execute(f"select text from '{sf_dir}/benchmark.parquet'").fetchall():
        w = WORDS.findall((t or "").translate(FOLD))
        grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    dirty = lambda w: any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1))
    rows = [(i, t) for i, t in rows if not dirty(WORDS.findall(t.translate(FOLD)))]
    own = tokenizers.Tokenizer.from_file(path)
    want = {}
    for i, t in rows:
        ids = own.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < 200


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "you idiot, you moron, you stupid scum", "en"), (None, "one text of some words", None)], "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "n": F.lit(2), "token": F.lit("t")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() >= 2
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.count() == 0 and none.columns == docs.columns


def test_stages_of_repeated_and_long_rows(spark, sf_dir):
    long = "a long text of words " * 20000
    rows = [(1, long), (2, long.upper()), (3, "short text"), (3, "short text"), (4, long + "with an end"), (5, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "tokens": F.lit("t")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        left = sorted(str(r["doc_id"]) for r in docs.collect())
        assert left == {"toxicity": ["1", "2", "3", "3", "4", "5", "None"], "exact_dedup": ["2", "3", "4", "5"], "near_dedup": ["2", "3", "4", "5"], "decontamination": ["2", "3", "4", "5"]}[name]
    name, last = corpus_pipeline.STAGES[-1]
    out = {r["doc_id"]: r for r in last(spark, docs, sf_dir).collect()}
    assert out[5]["n_tokens"] == 0 and len(out[2]["tokens"]) == out[2]["n_tokens"] > 50000
    assert last(spark, docs.limit(0), sf_dir).count() == 0


def test_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in found if re.match(r"op\d", k)} and "pipeline" in found


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_chat_formatting", "op5_warc_fixity", "op8_decontamination"])
def test_query_matches_oracle(name, same_as_oracle):
    same_as_oracle(__spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
