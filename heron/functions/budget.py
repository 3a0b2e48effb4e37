"""Running sums over a key in two levels, so that one key with all rows is many tasks.

Rows are dealt by ranges of key and order and written; each range is summed up in itself, and what
the ranges before it hold of the key is added: one row for each key and range, which is all that ever
meets in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heron.session import folder


def running_sums(rows: DataFrame, keys: list[str], order: list[str], amount: str, ranges: int | None = None) -> DataFrame:
    """rows with `held`: the sum of amount over the rows of the key before it, by order and then by amount. Nulls count 0; null keys are one key."""
    spark, place = rows.sparkSession, folder(rows.sparkSession)
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(place)
    stored = spark.read.schema(dealt.schema).parquet(place)
    value = F.coalesce(F.col(amount), F.lit(0))
    sums = stored.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(*keys, "_range").orderBy(*order, amount).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = stored.withColumn("_own", F.coalesce(own, F.lit(0))).join(offsets, same)
    return both.select(*rows.columns, (F.col("_own") + F.col("_before")).alias("held"))
