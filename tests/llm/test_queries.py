"""The registered queries without SQL against brute force, over the whole tables of the smallest size."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from heron.llm import quality, toxicity
from tests.llm.test_groups import components_of
from tests.llm.test_models import plainly

KINDS = ("email", "ip", "card", "phone")


@pytest.fixture(scope="module")
def rows(sf_dir):
    return [(i, t or "") for i, t in duckdb.connect().execute(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()]


def result(spark, sf_dir, name):
    return {r["doc_id"]: r for r in __spark_entry__.queries()[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name,module,label,least", [("op2_toxicity", toxicity, "toxic", 0.5), ("op10_quality", quality, "quality", 0.3)])
def test_scores(spark, sf_dir, rows, name, module, label, least):
    out = result(spark, sf_dir, name)
    said = dict(duckdb.connect().execute(f"select doc_id, {label} from '{sf_dir}/labels.parquet'").fetchall())
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert out.keys() == {i for i, _ in rows} and all(r["held_out"] == fold(i) for i, r in out.items())
    assert all(r["predicted"] == int(r["score"] >= least) and 0 <= r["score"] <= 1 for r in out.values())
    model = module.fit(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels")))
    one = (lambda t: model.score(t)) if module is toxicity else (lambda t: model.score(pa.array([t]))[0])
    assert all(abs(out[i]["score"] - one(t)) < 1e-9 for i, t in rows)
    right = [out[i]["predicted"] == y for i, y in said.items() if fold(i) and i in out and y is not None]
    assert np.mean(right) > 0.9


def test_bpe(spark, sf_dir, rows):
    own = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    out = result(spark, sf_dir, "op4_bpe")
    assert len(out) == len(rows)
    for i, t in rows:
        ids = own.encode(t, add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == want


def test_repeats(spark, sf_dir, rows):
    seen, raw = {}, {i: t.encode() for i, t in rows}
    for b in raw.values():
        for k in range(len(b) - 199):
            h = hash(b[k : k + 200])
            seen[h] = seen.get(h, 0) + 1
    out = result(spark, sf_dir, "op6_repeats")
    assert len(out) == len(rows)
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int(((gone[1:] != gone[:-1]).sum() + gone[0]) // 2)
        got = out[i]
        assert (got["n_bytes"], got["n_removed"], got["n_spans"], got["kept_sha256"]) == (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_personal_data(spark, sf_dir, rows):
    out = result(spark, sf_dir, "op7_pii")
    assert len(out) == len(rows)
    for i, t in rows:
        spans = sorted(plainly(t), key=lambda s: (KINDS.index(s[0]), s[1]))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert out[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        assert {s for s in text.split(",") if s} <= set(out[i]["spans"].split(","))


def test_near_duplicates(spark, sf_dir, rows):
    out = result(spark, sf_dir, "op9_minhash_near_dedup")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == components_of(rows)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())
