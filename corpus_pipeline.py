"""Corpus cleaning in five stages, each calling one operator of heron.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.llm import toxicity
from heron.llm.bpe import digests
from heron.llm.common import discard, discard_since, mark, release, stored, table
from heron.llm.decontaminate import clean
from heron.llm.exact_dedup import keep_one
from heron.llm.minhash import keep_first
from heron.llm.queries import tokenizer_path


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from labels outside the held-out fold, scores under 0.5; null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(~toxicity.toxic(F.col("text"), model))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts, that of the largest doc_id; null counts as empty, and of rows that repeat id and text one stays."""
    return keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; texts without words and null ids stay."""
    release(spark)
    return keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of any benchmark item; texts without words stay, and so do all if there is no item."""
    release(spark)
    return clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every text with digests of them and of the decoded text; null counts as empty."""
    release(spark)
    return digests(docs, tokenizer_path(), tokens=True, lean=True)


# All stages take whole texts of any length, ties and repeated rows, empty tables (which stay empty)
# and further columns of any name, which are kept by all but the last.
STAGES = [("toxicity", not_toxic), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("bpe", encoded)]

#: Stages with a trained model or a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept; what a stage wrote on its way is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, point = docs, mark()
        docs = stored(stage(spark, docs, sf_dir), name)
        discard_since(spark, point, keep=docs)
        if hasattr(before, "_heron_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
