"""What to crawl next: new addresses of each site in order, under robots rules, a bounded number a site.

Seen addresses are held as Bloom filters: for each site bitmaps of SLOT_BITS bits, one for about
SLOT_ADDRESSES addresses, so that a large site has many. An address whose bits aren't all set is new;
only the others are held against the seen addresses themselves, so the result is exact. The best k of
a site are picked in every task before any row moves.

Cases: null sites and addresses are left out; an address counts once, at its best place; equal places
go by address. No seen addresses, no robots files and empty tables are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.functions.robots import decisions

#: Bits of a bitmap (what bitmap_construct_agg makes), addresses that share one, bits of an address.
SLOT_BITS, SLOT_ADDRESSES, HASHES = 32768, 2048, 3


def _bits(address: Column) -> Column:
    first, step = F.xxhash64(address), F.xxhash64(address, F.lit("step"))
    return F.array(*(F.pmod(F.shiftright(first, 1) + k * F.shiftright(step, 2), F.lit(SLOT_BITS)) for k in range(HASHES)))


def _slot(address: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(address, F.lit("slot")), slots)


def seen_filters(seen: DataFrame) -> DataFrame:
    """site, slots, slot, bits: Bloom filters of the seen addresses (site, address)."""
    known = seen.filter("site is not null and address is not null").select("site", "address")
    slots = known.groupBy("site").agg(F.ceil(F.count(F.lit(1)) / SLOT_ADDRESSES).alias("slots"))
    cut = known.join(slots, "site").select("site", "slots", _slot(F.col("address"), F.col("slots")).alias("slot"), F.explode(_bits(F.col("address"))).alias("bit"))
    return cut.groupBy("site", "slots", "slot").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def _all_set(bits: Column, wanted: Column) -> Column:
    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.floor(byte / F.pow(F.lit(2), p % 8)) % 2 == 1

    return F.forall(wanted, is_set)


def fresh(found: DataFrame, seen: DataFrame) -> DataFrame:
    """The rows of found (site, address, and what else) whose address has not been seen."""
    filters = seen_filters(seen)
    slots = filters.groupBy("site").agg(F.first("slots").alias("_slots"))
    placed = found.join(slots, "site", "left").withColumn("_slot", _slot(F.col("address"), F.col("_slots")))
    held = filters.select(F.col("site"), F.col("slot").alias("_slot"), F.col("bits").alias("_filter"))
    asked = placed.join(held, ["site", "_slot"], "left").withColumn("_maybe", F.coalesce(_all_set(F.col("_filter"), _bits(F.col("address"))), F.lit(False)))
    kept = [F.col(c) for c in found.columns]
    new = asked.filter(~F.col("_maybe")).select(*kept)
    return new.unionByName(asked.filter("_maybe").select(*kept).join(seen.select("site", "address"), ["site", "address"], "left_anti").select(*kept))


def frontier(start: DataFrame, listed: DataFrame, seen: DataFrame, files: DataFrame, agent: str, most: int = 50) -> DataFrame:
    """site, place, address: start addresses, then listed ones (site, address, path, ofs), each in order; listed ones under the sites' robots files."""
    columns = ["site", "address", "path", "ofs"]
    both = start.select(*columns, F.lit(0).alias("rank")).unionByName(listed.select(*columns, F.lit(1).alias("rank"))).filter("site is not null and address is not null")
    once = both.groupBy("site", "address").agg(F.min(F.struct("rank", "ofs", "path")).alias("b")).select("site", "address", "b.*")
    new = fresh(once, seen).withColumnRenamed("site", "domain")
    open_ = decisions(new, files, agent).filter("allowed or rank = 0")
    place = F.row_number().over(Window.partitionBy("domain").orderBy("rank", "ofs", "address"))
    return open_.withColumn("place", place).filter(F.col("place") <= most).select(F.col("domain").alias("site"), "place", "address")
