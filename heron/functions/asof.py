"""As-of join: each row with the last row of another table at or before its time.

Both sides are put together in order of time, and the other side's last row is carried on. That is
done within buckets of time, so that a key with very many rows is many groups; what a bucket begins
with is the last row of an earlier bucket of the key, found among bucket ends alone: one row for
each key and bucket. So no task sees all rows of a key, and both passes share one shuffle by key and
bucket.

Cases: equal times count as before, unless strict; of equal times on the other side the one that is
last by `tie`, then by its columns. Null keys or times find nothing and are kept. Rows that repeat
are answered each. A key with no earlier row, or only one older than `within`, gets nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other_at: str, columns: list[str], bucket: int, tie: list[str] | None = None, strict: bool = False, within: int | None = None) -> DataFrame:
    """left with `columns` and other_at of the right row before it. at, other_at: long columns of one unit, as bucket and within are; all names differ but the keys."""
    tie = tie or []
    held = F.struct(F.col(other_at), *tie, *(c for c in columns if c not in tie))
    after = 0 if strict else 1  # which side comes first at equal times
    some = right.filter(" and ".join(f"`{c}` is not null" for c in [*keys, other_at]))
    events = some.select(*keys, F.floor(F.col(other_at) / bucket).alias("_bucket"), F.col(other_at).alias("_at"), F.lit(1 - after).alias("_side"), held.alias("_held"))
    asked = left.select(*keys, F.floor(F.col(at) / bucket).alias("_bucket"), F.col(at).alias("_at"), F.lit(after).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = asked.unionByName(events, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_side", F.col("_held").asc_nulls_first())
    carried = both.withColumn("_held", F.last("_held", ignorenulls=True).over(order)).filter("_row is not null")
    # of buckets with rows of the other side: the last row; of all buckets: the last row before them
    ends = events.groupBy(*keys, "_bucket").agg(F.max("_held").alias("_end"))
    buckets = asked.filter(" and ".join(f"`{c}` is not null" for c in [*keys, "_at"])).select(*keys, "_bucket").distinct()
    every = buckets.join(ends, [*keys, "_bucket"], "full")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    prior = every.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).filter("_before is not null").select(*keys, "_bucket", "_before")
    found = carried.join(prior, [*keys, "_bucket"], "left").select("_row", F.coalesce("_held", "_before").alias("_held"))
    known = F.col("_row")[at].isNotNull()
    for k in keys:
        known &= F.col("_row")[k].isNotNull()
    if within is not None:
        known &= F.col("_row")[at] - F.col("_held")[other_at] <= within
    return found.select("_row.*", *(F.when(known, F.col("_held")[c]).alias(c) for c in [other_at, *columns]))
