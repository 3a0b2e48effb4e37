"""Which pages a thing is on, in containers of bits: of 32,768 page numbers each, a bitmap or a short list.

A container with more than SPARSE pages is a bitmap of 4 KB however many they are, built up in every
task before anything moves; one with fewer is a sorted list. So an address that is on all pages costs
a bit a page, and one that is on three pages costs three numbers.

Cases: null pages are left out; a page counts once; page numbers may be negative or sparse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARSE = 256
#: Rows of dense containers' names that are broadcast at most.
FEW = 200_000


def containers(found: DataFrame, keys: list[str], page: str) -> DataFrame:
    """keys, bucket, n (pages), first (the smallest), bits or list: the pages that each key is found on."""
    placed = found.filter(F.col(page).isNotNull()).select(*keys, F.col(page).cast("long").alias("_page")).withColumn("bucket", F.bitmap_bucket_number("_page"))
    dense = placed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > SPARSE).drop("_rows")
    small = F.broadcast if dense.limit(FEW + 1).count() <= FEW else (lambda df: df)
    named = dense.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("bucket").alias("_bucket"))
    same = F.col("bucket") == F.col("_bucket")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("bits", "binary"), ("list", "array<bigint>"))]
    many = placed.join(small(named), same, "left_semi").groupBy(*keys, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_page")).alias("bits"), F.min("_page").alias("first"))
    few = placed.join(small(named), same, "left_anti").groupBy(*keys, "bucket").agg(F.array_sort(F.collect_set("_page")).alias("list"))
    bits = many.select(*keys, "bucket", F.bitmap_count("bits").alias("n"), "first", "bits", none[1])
    return bits.unionByName(few.select(*keys, "bucket", F.size("list").cast("long").alias("n"), F.get("list", F.lit(0)).alias("first"), none[0], "list"))


def pages_of(held: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """keys, page: the containers opened again."""
    byte = F.posexplode(F.split(F.regexp_replace(F.hex("bits"), "(..)(?!$)", "$1,"), ","))
    opened = held.filter("bits is not null").select(*keys, "bucket", byte.alias("_at", "_hex")).filter("_hex <> '00'")
    value = F.conv("_hex", 16, 10).cast("int")
    which = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.when(F.floor(value / F.pow(F.lit(2), b)) % 2 == 1, b)), lambda b: b.isNotNull()))
    bit = F.col("_at") * 8 + F.col("_bit")
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + 1 + bit).otherwise(F.col("bucket") * 32768 - bit)
    of_bits = opened.select(*keys, "bucket", "_at", which.alias("_bit")).select(*keys, number.alias(page))
    return of_bits.unionByName(held.filter("list is not null").select(*keys, F.explode("list").alias(page)))
