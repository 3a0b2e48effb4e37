"""Bounded labelled samples for the classifiers, and the held-out fold they never see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on: at most so many, those with the smallest hash of doc_id.
SAMPLE_ROWS = 6000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 5 is 0; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """(text, label) of the training fold's sample, in a fixed order. Rows without a label are left out."""
    fold = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pick = fold.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("_label").alias("_label"))
    return [(r["text"], r["_label"]) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
