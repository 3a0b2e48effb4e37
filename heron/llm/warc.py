"""WARC archives and a Merkle fixity audit of their replicas.

`write` lays pages out as WARC resource records, in order of id, FILE_PAGES ids to a gzip file in a
folder of its own. `read` takes the records of such an archive back from its bytes: the files are cut
where a record's first line stands, and a piece whose length isn't what its header says (a page that
holds such a line, a damaged header) makes its file be parsed from end to end instead. `foreign`
parses archives of any make, gzip members too.

A leaf is a record's byte range in its file and its SHA-256; FANOUT nodes in order make a node, whose
hash covers its byte range and its children's hashes, up to one root a file. Two replicas are compared
root by root; only the children of mismatching nodes are looked at further, down to the records.
Those are then matched within their file by hash and by id: what has the same bytes elsewhere has
moved (all that follows an inserted record), what has other bytes is changed, the rest is missing or
added. Once an archive is written only offsets and hashes are shuffled, and each level is stored.

Cases: null url and html count as empty. Records of one id (repeated rows) are ordered by hash.
Null ids make one file, -1: it is written by one task, as is any file. A very long page is one long
record. An empty replica gives no nodes; against another, all that one's records are missing or
added. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heron.llm.common import new_place, stored
from heron.session import ship

FILE_PAGES, FANOUT, LEVELS = 1000, 16, 3
WRITING = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: How a record begins, and how it ends.
FIRST, LAST = "WARC/1.0\r\nWARC-Type: ", "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's record, as text."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit(FIRST + "resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(LAST), body, F.lit(LAST))


#: Header names as they are given back, however a file writes them.
_NAMES = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "Content-Type", "Content-Length")}


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, body) of each record; a damaged stretch has an empty header."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        fields = {}
        if archive.startswith(b"WARC/", at) and end >= 0:
            for line in archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                fields[_NAMES.get(name.strip().lower(), name.strip())] = value.strip()
        size = fields.get("Content-Length", "")
        stop = end + 4 + int(size) if size.isdigit() else -1
        if stop >= 0 and archive.startswith(b"\r\n\r\n", stop):
            yield at, stop + 4 - at, fields, archive[end + 4 : stop]
            at = stop + 4
        else:
            found = archive.find(b"WARC/", at + 1)
            found = len(archive) if found < 0 else found
            yield at, found - at, {}, archive[at:found]
            at = found


#: How a gzip member begins; compressed bytes that are read at a time.
MEMBER, STEP = b"\x1f\x8b\x08", 1 << 14


def _begins(data: bytes, at: int) -> int:
    """Where the deflated bytes of the member at `at` begin; -1 if its header isn't whole."""
    flags, place = data[at + 3] if at + 10 <= len(data) else 0, at + 10
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for flag in (8, 16):  # a name, a comment: up to a zero
        if flags & flag:
            place = data.find(b"\0", place) + 1 or len(data) + 1
    place += 2 if flags & 2 else 0
    return place if place <= len(data) else -1


def _inflated(data: bytes, at: int, out: list[bytes]) -> int:
    """Adds what can be read of the member at `at` to out; where the next one is looked for.

    Checksums aren't asked for: fixity is the caller's, and a wrong one must not cost the bytes.
    """
    place = _begins(data, at)
    if place < 0:
        return len(data)
    member = zlib.decompressobj(-15)
    while not member.eof and place < len(data):
        piece, before = data[place : place + STEP], member.copy()
        try:
            out.append(member.decompress(piece))
        except zlib.error:
            for k in range(len(piece)):  # byte by byte up to the damage
                try:
                    out.append(before.decompress(piece[k : k + 1]))
                except zlib.error:
                    break
            return at + 1
        place += len(piece)
    out.append(member.flush())
    return place - len(member.unused_data) + 8 if member.eof else len(data)


def unzipped(data: bytes) -> bytes:
    """The bytes of gzip members one after the other, whole or as far as each can be read; other bytes as they are."""
    if not data.startswith(MEMBER[:2]):
        return data
    out: list[bytes] = []
    at = 0
    while at < len(data):
        at = data.find(MEMBER, at)
        if at < 0:
            break
        at = _inflated(data, at, out)
    return b"".join(out)


def foreign(spark: SparkSession, path: str) -> DataFrame:
    """file, record_offset, n_bytes, kind, target, body of the records of whole archives of any make; kind is null for a damaged stretch.

    An archive is read by one task, so it must fit in its memory.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "record_offset", "n_bytes", "kind", "target", "body"]
        for batch in batches:
            for file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(file, at, n, f.get("WARC-Type"), f.get("WARC-Target-URI"), body) for at, n, f, body in parse(unzipped(data))]
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, record_offset long, n_bytes long, kind string, target string, body binary")


def _written(rows: DataFrame, order: list[str]) -> str:
    """Writes rows (file, record and what orders them) whose files lie in one partition each; the folder."""
    folder = new_place(rows.sparkSession, "archive")
    # the writer ends each record with its last byte, a line feed
    lines = rows.sortWithinPartitions("file", *order).select("file", F.expr("substring(record, 1, length(record) - 1)").alias("value"))
    lines.write.partitionBy("file").options(**WRITING).text(folder)
    return folder


def write(pages: DataFrame) -> str:
    """Writes the archive of pages (page_id, url, html) to the shared folder; its place."""
    held = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / FILE_PAGES), F.lit(-1)).cast("long").alias("file"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return _written(held.withColumn("sha", F.sha2("record", 256)).repartition("file"), ["page_id", "sha"])


@dataclass
class Archive:
    """records: file, at (place in the file), record (as text); leaves: page_id, file, node, start, end, hash, stored."""

    records: DataFrame
    leaves: DataFrame


def _marked(records: DataFrame) -> DataFrame:
    """file, at, page_id, bytes, hash, said (whether the length is what the header says) of records."""
    head = records.select("*", F.substring_index("record", LAST, 1).alias("head"))
    page = F.regexp_extract("head", r"\nWARC-Record-ID: <urn:page:(-?\d*)>", 1).try_cast("long")
    size = F.regexp_extract("head", r"\nContent-Length: (\d+)", 1).try_cast("long")
    bytes_ = F.octet_length("record").cast("long")
    said = F.coalesce(size == bytes_ - F.octet_length("head") - 2 * len(LAST), F.lit(False))
    return head.select("file", "at", page.alias("page_id"), bytes_.alias("bytes"), F.sha2("record", 256).alias("hash"), said.alias("said"))


def read(spark: SparkSession, folder: str) -> Archive:
    """An archive that `write` or `copy` wrote, with the leaves of its tree."""
    ship(spark)
    rows = spark.read.option("lineSep", FIRST).option("recursiveFileLookup", "true").text(folder)
    file = F.regexp_extract(F.col("_metadata.file_path"), r"/file=(-?\d+)/", 1).cast("long")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    records = rows.select(file.alias("file"), at.alias("at"), "value").filter("value <> '' or at.block > 0").select("file", "at", F.concat(F.lit(FIRST), "value").alias("record"))
    marks = stored(_marked(records), "records")
    odd = stored(marks.filter("not said").select("file").distinct(), "odd")
    if not odd.isEmpty():
        records = records.join(odd, "file", "left_anti").unionByName(_mended(records.join(odd, "file", "left_semi")))
        marks = stored(_marked(records), "records")
    order = Window.partitionBy("file").orderBy("at")
    end = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    leaves = marks.select("page_id", "file", (F.row_number().over(order) - 1).alias("node"), (end - F.col("bytes")).alias("start"), end.alias("end"), "hash")
    return Archive(records, stored(leaves, "leaves"))


def _mended(records: DataFrame) -> DataFrame:
    """The records of whole files, parsed from end to end; a file is parsed in one task."""

    def whole(part: pa.Table) -> pa.Table:
        part = part.sort_by([("block", "ascending"), ("k", "ascending")])
        data = "".join(part.column("record").to_pylist()).encode()
        cuts = [(a, data[a : a + n]) for a, n, _, _ in parse(data)]
        return pa.table({"file": pa.array([part.column("file")[0].as_py()] * len(cuts), pa.int64()), "block": pa.array([0] * len(cuts), pa.int64()), "k": pa.array([a for a, _ in cuts], pa.int64()), "record": pa.array([r.decode("utf-8", "replace") for _, r in cuts], pa.string())})

    again = records.select("file", "at.block", "at.k", "record").groupBy("file").applyInArrow(whole, "file long, block long, k long, record string")
    return again.select("file", F.struct("block", "k").alias("at"), "record")


def copy(records: DataFrame) -> str:
    """Writes the records of an archive to one of its own, without a shuffle where they are read from files; its place."""
    return _written(records, ["at"])


def parents(nodes: DataFrame, fanout: int | None = FANOUT) -> DataFrame:
    """file, node, start, end, hash one level up; without a fanout, the roots."""
    up = F.floor(F.col("node") / fanout).cast("int") if fanout else F.lit(0)
    children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: c["hash"]), ",")
    made = nodes.groupBy("file", up.alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), children.alias("children"))
    return made.select("file", "node", "start", "end", F.sha2(F.concat_ws(",", F.col("start").cast("string"), F.col("end").cast("string"), "children"), 256).alias("hash"))


def tree(of: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the roots, each stored."""
    levels = [of]
    for _ in range(LEVELS - 1):
        levels.append(stored(parents(levels[-1]), "nodes"))
    return [*levels, stored(parents(levels[-1], None), "roots")]


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """file, ours, theirs (places in the file, null where it isn't there), page_id, kind of the records that differ between two trees, found from the roots down.

    kind: changed, moved (the same bytes elsewhere in the file), missing (in theirs) or added.
    """
    bad = None
    for level in range(LEVELS, 0, -1):
        pick = lambda d: d.select("file", "node", F.struct("start", "end", "hash").alias("is"))
        a, b = (_under(pick(d[level]), bad, level) for d in (ours, theirs))
        both = a.join(b.withColumnRenamed("is", "other"), ["file", "node"], "full")
        bad = stored(both.filter(~F.col("is").eqNullSafe(F.col("other"))).select("file", "node"), "bad")
    a, b = (_under(d[0].select("file", "node", "page_id", "start", "end", "hash"), bad, 0) for d in (ours, theirs))
    same = a.join(b.withColumnsRenamed({"page_id": "p", "start": "s", "end": "e", "hash": "h"}), ["file", "node"], "full")
    differ = stored(same.filter(~(F.col("hash").eqNullSafe(F.col("h")) & F.col("start").eqNullSafe(F.col("s")) & F.col("end").eqNullSafe(F.col("e")))), "differ")
    # what is left on either side is matched by its bytes, then by its id, in order
    left = differ.filter("hash is not null").select("file", F.col("node").alias("ours"), "page_id", "hash")
    right = differ.filter("h is not null").select("file", F.col("node").alias("theirs"), F.col("p").alias("page_id"), F.col("h").alias("hash"))
    moved = _matched(left, right, ["file", "hash"])
    rest_l, rest_r = left.join(moved, ["file", "ours"], "left_anti"), right.join(moved, ["file", "theirs"], "left_anti")
    changed = _matched(rest_l, rest_r, ["file", "page_id"])
    gone, come = rest_l.join(changed, ["file", "ours"], "left_anti"), rest_r.join(changed, ["file", "theirs"], "left_anti")
    none = F.lit(None).cast("int")
    paired = moved.withColumn("kind", F.lit("moved")).unionByName(changed.withColumn("kind", F.lit("changed")))
    single = gone.select("file", "ours", none.alias("theirs"), "page_id", F.lit("missing").alias("kind")).unionByName(come.select("file", none.alias("ours"), "theirs", "page_id", F.lit("added").alias("kind")))
    return paired.unionByName(single)


def _under(nodes: DataFrame, bad: DataFrame | None, level: int) -> DataFrame:
    """The nodes whose parents are bad."""
    if bad is None:
        return nodes
    up = F.floor(F.col("node") / FANOUT).cast("int") if level < LEVELS - 1 else F.lit(0)
    return nodes.withColumn("up", up).join(bad.select("file", F.col("node").alias("up")), ["file", "up"], "left_semi").drop("up")


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """file, ours, theirs, page_id: the n-th of a key on one side with the n-th on the other; stored."""
    nth = lambda d, c: d.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(c)))
    a = nth(left, "ours").select(*(F.col(k).alias(f"_{k}") for k in keys), "nth", "ours", "page_id")
    b = nth(right, "theirs").select(*keys, F.col("nth").alias("_nth"), "theirs")
    b = b.drop("page_id") if "page_id" not in keys else b.withColumnRenamed("page_id", "_p")
    cond = (F.col("nth") == F.col("_nth")) & (F.col("_file") == F.col("file"))
    cond = cond & (F.col("_hash") == F.col("hash") if "hash" in keys else F.col("_page_id").eqNullSafe(F.col("_p")))
    return stored(a.join(b, cond).select("file", "ours", "theirs", "page_id"), "matched")
