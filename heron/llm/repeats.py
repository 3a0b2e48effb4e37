"""Removal of long repeated byte strings by longest-previous-factor arrays.

A string of SPAN bytes that starts at two places has, at both, the same smallest KMER-gram at the
same offset: its anchor. So every text is cut into runs of window starts that share an anchor, and
only runs whose anchor's hash occurs twice can repeat. Runs that are equal as a whole are folded
into one context with a count. Contexts that differ but share an anchor meet in one bucket, where
the windows' suffixes are sorted, the longest-common-prefix array is taken, and previous and next
smaller positions in suffix order give each window's longest earlier match (LPF) and, read the
other way, its longest later one. A window repeats if one of them reaches SPAN.

Anchors with very many different contexts (a common line in many surroundings) aren't compared at
once: their windows are dealt by what lies left and right of the anchor within narrower and
narrower ranges of offsets, until few enough meet or, at width one, whole windows are equal.
After each dealing, contexts that are equal within their range are folded again.

keep="none" removes every byte of a string that starts anywhere else; keep="first" leaves the first
place (by doc_id, hash of text, offset) and removes later copies.

Cases: null counts as empty; texts under SPAN bytes keep all. Matches don't cross documents, but
may overlap in one. Rows that repeat doc_id and text are copies of each other like any others (with
keep="first" they share one result). Null ids are kept and sort first. An empty table gives no
rows. Extra columns are ignored. Texts of any length are read in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import discard, pieces, skew_join, stored
from heron.llm.textcodec import _BYTE, U, _Powers, chunks, mix
from heron.session import ship

SPAN, KMER = 200, 32
WINDOW = SPAN - KMER + 1
#: Bytes of one long text hashed at a time.
PIECE = 1 << 18
_LOW = 22
#: Contexts of one anchor that are compared at once, and contexts in a bucket.
TOGETHER, BUCKET = 600, 600
WIDTHS = (43, 11, 1)
#: Texts, and ranges in them, that are broadcast at most (ids of 16 and ranges of 8 bytes); more are joined by shuffle.
FEW, FEW_SPANS = 500_000, 2_000_000


def _window_minima(v: np.ndarray) -> np.ndarray:
    """Smallest of each WINDOW neighbours, by running minima of blocks from both sides."""
    n = len(v) - WINDOW + 1
    pad = np.concatenate([v, np.full(-len(v) % WINDOW, np.iinfo(U).max, U)]).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[WINDOW - 1 : WINDOW - 1 + n])


def _runs(data: np.ndarray, offsets: np.ndarray):
    """(text, lo, hi, anchor, h, c): runs of window starts with one anchor; places are within data."""
    n = len(data)
    if n < SPAN:
        return None
    up, down = _Powers.get(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    grams = mix((total[KMER:] - total[:-KMER]) * down[: n - KMER + 1])
    keys = (grams >> U(_LOW) << U(_LOW)) | np.arange(len(grams), dtype=U)
    anchor = (_window_minima(keys) & U((1 << _LOW) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + SPAN <= offsets[text + 1]
    starts, text, anchor = starts[valid], text[valid], anchor[valid]
    if not len(starts):
        return None
    first = np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])])
    begin = np.flatnonzero(first)
    end = np.concatenate([begin[1:], [len(starts)]]) - 1
    lo, hi, at = starts[begin], starts[end], anchor[begin]
    c = mix((total[hi + SPAN] - total[lo]) * down[lo] + (hi - lo).astype(U) * U(0x9E3779B97F4A7C15))
    return text[begin], lo, hi, at, grams[at], c


def runs(keyed: DataFrame) -> DataFrame:
    """doc_id, text_key, lo, hi (first and last window start), at (anchor), h, c of every run; keyed has doc_id, text_key, text."""
    ship(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            for first, offsets, data in chunks(batch.column(2)):
                long = len(offsets) == 2 and len(data) > 2 * PIECE
                cuts = [(a, data[a : a + PIECE + SPAN - 1]) for a in range(0, len(data) - SPAN + 1, PIECE)] if long else [(0, data)]
                for base, part in cuts:
                    found = _runs(part, np.array([0, len(part)]) if long else offsets)
                    if found is None:
                        continue
                    text, lo, hi, at, h, c = found
                    begin = offsets[text] - base
                    rows = pa.array(text + first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array((x - begin).astype(np.int32)) for x in (lo, hi, at)), *(pa.array(x.view(np.int64)) for x in (h, c))],
                        ["doc_id", "text_key", "lo", "hi", "at", "h", "c"],
                    )

    return keyed.mapInArrow(run, "doc_id long, text_key long, lo int, hi int, at int, h long, c long")


def smaller_before(pos: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the nearest rank before with a smaller position, -1 for none, and the longest common prefix with it.

    lcp[r] is that of ranks r - 1 and r. Ranks skip along each other's answers until all stand.
    """
    n = len(pos)
    back, common = np.arange(n) - 1, lcp.copy()
    active = np.flatnonzero(back >= 0)
    active = active[pos[back[active]] > pos[active]]
    while len(active):
        j = back[active]
        common[active] = np.minimum(common[active], common[j])
        back[active] = back[j]
        active = active[back[active] >= 0]
        active = active[pos[back[active]] > pos[active]]
    return back, np.where(back >= 0, common, 0)


def factors(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each rank: the longer of the matches with both smaller neighbours."""
    _, before = smaller_before(pos, lcp)
    _, after = smaller_before(pos[::-1], np.concatenate([[0], lcp[:0:-1]]))
    return np.maximum(before, after[::-1])


def _repeating(windows: np.ndarray, later_too: bool) -> np.ndarray:
    """Which rows of a (windows, SPAN) byte matrix, in order of position, have an equal row before (or, later_too, after)."""
    order = np.argsort(np.ascontiguousarray(windows).view(f"V{SPAN}").ravel(), kind="stable")
    rows = windows[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), SPAN)])
    best = factors(order, lcp)
    if later_too:
        best = np.maximum(best, factors(len(order) - 1 - order, lcp))
    out = np.zeros(len(order), bool)
    out[order] = best >= SPAN
    return out


def _bucket(keep: str):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("text_key", "ascending"), ("lo", "ascending"), ("frm", "ascending")])
        bodies, frm, to = part.column("body").to_pylist(), part.column("frm").to_numpy(), part.column("to").to_numpy()
        views = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, np.uint8), SPAN)[f : t + 1] for b, f, t in zip(bodies, frm, to, strict=True)]
        size = np.array([len(v) for v in views])
        again = _repeating(np.concatenate(views), keep == "none")
        row = np.repeat(np.arange(len(views)), size)
        start = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + frm[row]
        wanted = np.ones(len(views), bool) if keep == "first" else part.column("cnt").to_numpy() == 1
        return _ranges(part, row[again & wanted[row]], start[again & wanted[row]])

    return run


def _ranges(part: pa.Table, row: np.ndarray, start: np.ndarray) -> pa.Table:
    """Byte ranges that cover windows at start of rows, joined where they touch."""
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + SPAN)]) if len(row) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    end = np.concatenate([begin[1:], [len(row)]])[: len(begin)] - 1
    at = pa.array(row[begin])
    lo = part.column("lo").to_numpy()[row[begin]]
    return pa.table({"doc_id": part.column("doc_id").take(at), "text_key": part.column("text_key").take(at), "s": pa.array((lo + start[begin]).astype(np.int32)), "e": pa.array((lo + start[end] + SPAN).astype(np.int32))})


RANGES = "doc_id long, text_key long, s int, e int"
CONTEXT = "key long, doc_id long, text_key long, lo int, anchor int, cnt long, frm int, to int, body binary"


def _narrowed(contexts: DataFrame, width: int) -> DataFrame:
    """Deals each context to keys of what all its windows within a range of offsets have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, doc, text, lo, a, cnt, frm, to, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # the window at s has r = s - a + SPAN - KMER bytes right of the anchor
                shift = SPAN - KMER - a
                for q in range((frm + shift) // width, (to + shift) // width + 1):
                    r0, r1 = q * width, min((q + 1) * width, WINDOW)
                    f, t = max(frm, r0 - shift), min(to, r1 - 1 - shift)
                    common = body[a - (SPAN - KMER - r1 + 1) : a + KMER + r0]
                    h = hashlib.blake2b(common, digest_size=8, key=q.to_bytes(2, "little")).digest()
                    out.append((int.from_bytes(h, "little", signed=True), doc, text, lo, a, cnt, f, t, body))
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), batch.schema, strict=True)], schema=batch.schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), batch.schema, strict=True)], schema=batch.schema)

    return contexts.mapInArrow(run, CONTEXT)


def _folded(narrowed: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """Contexts (as CONTEXT) of which those of one key with the same windows are one, and the ranges that this finds to repeat.

    narrowed is stored and has c besides, the hash of all bytes of its windows.
    """
    start = (F.col("lo") + F.col("frm")).alias("start")
    groups = narrowed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("cnt"), F.sum("cnt").alias("copies"), F.min(F.struct("doc_id", "text_key", start, "lo", "anchor", "frm", "to", "body")).alias("first"))
    groups = stored(groups, "folded")
    again = groups.filter("cnt > 1").select("key", "c", "cnt", F.struct("first.doc_id", "first.text_key", "first.start").alias("first"))
    total = groups.agg(F.sum("cnt")).first()[0] or 0
    met = skew_join(narrowed.select("key", "c", "doc_id", "text_key", "lo", "frm", "to", F.col("cnt").alias("copies")), again, ["key", "c"], total)
    chosen = (F.col("copies") == 1) if keep == "none" else (F.struct("doc_id", "text_key", start) != F.col("first"))
    ranges = met.filter(chosen).select("doc_id", "text_key", (F.col("lo") + F.col("frm")).alias("s"), (F.col("lo") + F.col("to") + SPAN).alias("e"))
    one = groups.select("key", "first.doc_id", "first.text_key", "first.lo", "first.anchor", F.col("copies").alias("cnt"), "first.frm", "first.to", "first.body")
    return one, ranges


def _compared(contexts: DataFrame, keep: str) -> DataFrame:
    """Ranges of contexts (as CONTEXT) whose windows repeat in another context of the same key."""
    out = None
    for width in WIDTHS:
        counts = stored(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
        total = counts.agg(F.sum("n")).first()[0] or 0
        few = counts.filter(f"n between 2 and {TOGETHER}")
        many = counts.filter(f"n > {TOGETHER}").select("key", F.col("n").alias("m"))
        buckets = max(1, total // BUCKET)
        some = contexts.join(few.select("key"), "key", "left_semi").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        ranges = some.groupBy("bucket").applyInArrow(lambda part: _bucket(keep)(part), RANGES)
        out = ranges if out is None else out.unionByName(ranges)
        if many.isEmpty():
            return out
        held = skew_join(contexts.withColumnRenamed("cnt", "copies"), many.select("key", F.col("m").alias("cnt")), ["key"], total).drop("cnt").withColumnRenamed("copies", "cnt")
        narrowed = _narrowed(held.select(*contexts.columns), width).withColumn("c", F.sha2(F.substring(F.col("body"), F.col("frm") + 1, F.col("to") - F.col("frm") + SPAN), 256))
        # windows within a common passage are folded here, by ranges of offsets rather than one by one
        contexts, ranges = _folded(stored(narrowed, "narrowed"), keep)
        out = out.unionByName(ranges)
    return out  # keys are whole windows now, and equal ones are folded


def repeated_ranges(keyed: DataFrame, keep: str = "none") -> DataFrame:
    """doc_id, text_key, removed: sorted disjoint (s, e) byte ranges to remove from each text that has any; stored."""
    occurrences = stored(runs(keyed), "runs")
    anchors = occurrences.groupBy("h").agg(F.count(F.lit(1)).alias("cnt"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("cnt > 1")
    anchors = stored(anchors, "anchors")
    again = skew_join(occurrences, anchors, ["h"], occurrences.count())
    again = stored(again.select(*occurrences.columns, (F.col("c0") != F.col("c1")).alias("several")), "again")
    discard(occurrences)
    context = ["h", "c", "w", "a"]
    shaped = again.withColumns({"w": F.col("hi") - F.col("lo"), "a": F.col("at") - F.col("lo")})
    folded = stored(shaped.groupBy(*context, "several").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("doc_id", "text_key", "lo")).alias("first")), "contexts")
    copies = skew_join(shaped, folded.filter("cnt > 1").select(*context, "cnt", "first"), context, shaped.count())
    if keep == "first":
        copies = copies.filter(F.struct("doc_id", "text_key", "lo") != F.col("first"))
    whole = copies.select("doc_id", "text_key", F.col("lo").alias("s"), (F.col("hi") + SPAN).alias("e"))
    # one place of each context of an anchor that has several, with its bytes
    places = folded.filter("several").select("h", "w", "a", "cnt", "first.*").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("h", "w", "a", "cnt", "lo")).alias("p"))
    places = stored(places.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "p"), "places")
    held = F.expr("doc_id <=> d and text_key = k")
    few = places.count() <= FEW  # then only these texts are shuffled
    some = keyed.join(F.broadcast(places.select("d", "k")), held, "left_semi") if few else keyed
    spelt = some.join(places, held).dropDuplicates(["doc_id", "text_key"])
    bodies = spelt.select("doc_id", "text_key", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"), "p").select("doc_id", "text_key", F.expr("explode(transform(p, x -> named_struct('h', x.h, 'w', x.w, 'a', x.a, 'cnt', x.cnt, 'lo', x.lo, 'body', substring(bytes, x.lo + 1, x.w + 200))))").alias("x"))
    contexts = bodies.select(F.col("x.h").alias("key"), "doc_id", "text_key", "x.lo", F.col("x.a").alias("anchor"), "x.cnt", F.lit(0).alias("frm"), F.col("x.w").alias("to"), "x.body")
    ranges = whole.unionByName(_compared(stored(contexts, "bodies"), keep))
    listed = ranges.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("r"))
    return stored(listed.select("doc_id", "text_key", _merged(F.col("r")).alias("removed")), "removed")


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _merged(ranges: Column) -> Column:
    """Sorted ranges (s, e) joined where they touch or overlap, in time linear in their number."""

    @F.arrow_udf("array<struct<s:int,e:int>>")
    def merge(lists: pa.Array) -> pa.Array:
        flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        s, e = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # ends so far, by rows that come after each other: a row's own ends are beyond all of the row before
        far = np.int64(1) << 32
        reach = np.maximum.accumulate(e + row * far) - row * far
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] > reach[:-1])]) if len(s) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        last = np.concatenate([begin[1:], [len(s)]])[: len(begin)] - 1
        spans = pa.StructArray.from_arrays([pa.array(s[begin], pa.int32()), pa.array(reach[last].astype(np.int32))], ["s", "e"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, at).astype(np.int32)), spans)

    return merge(ranges)


def _left(body: Column, removed: Column) -> Column:
    """What lies outside the removed ranges, in order."""

    @F.arrow_udf("binary")
    def cut(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for body, spans in zip(bodies, lists, strict=True):
            if not body.is_valid:
                out.append(None)
                continue
            data, s, e = memoryview(body.as_buffer()), spans.values.field(0).to_pylist(), spans.values.field(1).to_pylist()
            out.append(b"".join(data[a:b] for a, b in zip([0, *e], [*s, len(data)], strict=True)))
        return pa.array(out, pa.binary())

    return cut(body, removed)


def remove_repeats(docs: DataFrame, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, removed (ranges), kept (the remaining bytes) of every row."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    ship(docs.sparkSession)
    ranges = repeated_ranges(keyed, keep).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    rows, spans = ranges.agg(F.count(F.lit(1)), F.sum(F.size("removed"))).first()
    few = rows <= FEW and (spans or 0) <= FEW_SPANS
    joined = keyed.join(F.broadcast(ranges) if few else ranges, F.expr("doc_id <=> d and text_key = k"), "left")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = joined.select("doc_id", body.alias("bytes"), F.coalesce("removed", F.expr("cast(array() as array<struct<s:int,e:int>>)")).alias("removed"))
    touched = F.size("removed") > 0  # only these texts go through Python
    kept = F.coalesce(_left(F.when(touched, F.col("bytes")), F.when(touched, F.col("removed"))), F.col("bytes"))
    return rows.select("doc_id", F.length("bytes").cast("long").alias("n_bytes"), "removed", kept.alias("kept"))
