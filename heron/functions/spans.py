"""Places in texts, as arrays of spans in the JVM: no Python, no row for each match.

A span is (start, end, raw) in code points, end exclusive. Where a match lies follows from the texts
between the matches: running sums of their lengths. Sums and pieces of text are taken by blocks, so
that a long text with many matches costs little more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values summed at a time, and code points of a text's block.
RUN, BLOCK = 256, 4096
SPAN = "array<struct<start:int,end:int,raw:string>>"
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def bound(value: Column, f) -> Column:
    """f of value with value computed once."""
    return F.transform(F.array(value), f)[0]


def _sums(values: Column, first: Column) -> Column:
    zero = F.struct(first.cast("int").alias("t"), F.array().cast("array<int>").alias("a"))

    def add(held: Column, x: Column) -> Column:
        return F.struct((held["t"] + x).cast("int").alias("t"), F.array_append(held["a"], held["t"] + x).cast("array<int>").alias("a"))

    return F.aggregate(values, zero, add, lambda held: held["a"])


def running(values: Column) -> Column:
    """Running sums of an array of ints, each with its own value; an empty array for an empty one."""

    def of(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / RUN).cast("int") - 1), lambda b: F.slice(v, b * RUN + 1, F.lit(RUN)))
        whole = lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)
        told = lambda ps: bound(_sums(F.transform(ps, whole), F.lit(0)), lambda t: F.flatten(F.transform(ps, lambda p, b: _sums(p, F.coalesce(F.get(t, b - 1), F.lit(0))))))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(bound(parts, told))

    return bound(values, of)


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern that matches no empty text, from left to right; null for null."""

    def of(t: Column) -> Column:
        def placed(raw: Column) -> Column:
            steps = F.zip_with(F.slice(F.split(t, pattern), F.lit(1), F.size(raw)), raw, lambda p, r: F.length(p) + F.length(r))
            return F.zip_with(running(steps), raw, lambda e, r: F.struct((e - F.length(r)).alias("start"), e.alias("end"), r.alias("raw")))

        return bound(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda raw: F.when(F.size(raw) == 0, F.array().cast(SPAN)).otherwise(placed(raw)))

    return bound(text, of)


def between(text: Column, pattern: str) -> Column:
    """(start, end) of what lies between the matches, the empty ones too."""

    def of(found: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["end"]))
        ends = F.concat(F.transform(found, lambda s: s["start"]), F.array(F.length(text)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    return bound(spans(text, pattern), of)


def pieces(text: Column, wanted: Column, f) -> Column:
    """f(element, take) of each element of wanted, where take(a, b) is the text from a to b: by block, not from the beginning."""

    def of(blocks: Column) -> Column:
        def take(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            count = F.floor((b - 1) / BLOCK).cast("int") - first + 1
            return F.when(b <= a, F.lit("")).otherwise(F.substring(F.array_join(F.slice(blocks, first + 1, count), ""), a - first * BLOCK + 1, b - a))

        return F.transform(wanted, lambda x: f(x, take))

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), of)


def located(text: Column, patterns: list[tuple[str, str]], around: int) -> Column:
    """Mentions (start, end, raw, unit, context) by pattern, then place; patterns are matched in any case and may overlap."""

    def of(t: Column) -> Column:
        found = F.concat(*(_named(spans(t, f"(?iU){p}"), unit) for p, unit in patterns))

        def with_context(s: Column, take) -> Column:
            near = take(F.greatest(F.lit(0), s["start"] - around), s["end"] + around)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"), s["unit"].alias("unit"), F.regexp_replace(near, rf"\A{BLANKS}|{BLANKS}\z", "").alias("context"))

        return bound(found, lambda w: F.when(F.size(w) == 0, F.array().cast("array<struct<start:int,end:int,raw:string,unit:string,context:string>>")).otherwise(pieces(t, w, with_context)))

    return bound(F.coalesce(text, F.lit("")), of)


def _named(found: Column, unit: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw"), F.lit(unit).alias("unit")))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows of left (keys, start, end) with each row of right (keys, other_start, other_end) that they share a place with.

    Both sides are dealt over buckets of `width` places, so that a key with very many intervals is
    many keys, and a pair is given in the first bucket that both lie in, hence once. Empty intervals
    share nothing; null keys and places meet nothing.
    """

    def dealt(df: DataFrame, a: str, b: str, to: str) -> DataFrame:
        first, last = F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)
        return df.filter(F.col(a) < F.col(b)).withColumn(to, first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    both = dealt(left, "start", "end", "_a").join(dealt(right, "other_start", "other_end", "_b"), [*keys, "_bucket"])
    return both.filter("start < other_end and other_start < end and _bucket = greatest(_a, _b)").drop("_bucket", "_a", "_b")
