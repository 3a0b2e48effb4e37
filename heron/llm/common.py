"""Shared plumbing: table access, shared storage, text folding and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.session import ship

#: Bytes of text in one piece of an Arrow batch that Python works on at a time; a longer text is a piece.
PIECE_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most this many keys can each hold more than one part in so many of all rows.
HEAVY_PARTS = 1000
HEAVY_LEAST = 200

#: Rows of an Arrow batch while a table is stored: the JVM keeps the memory of the largest batch it made.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

#: Files of a stored table, at most: so many for each core, or one for so many shuffle partitions where
#: that is more. Each costs round trips to the store, however small.
FILES_PER_CORE, PARTITIONS_PER_FILE = 4, 8

#: Places of tables written by stored() and not deleted yet, and the folder where a local session has none set.
_written: list[str] = []
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes of column `text` each, one row at least."""
    for batch in batches:
        size = batch.column(text).cast(pa.large_string())
        bounds = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1] if len(size) else np.zeros(1, np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session (tests) may lack one and gets its own."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="heron-shared-"))
    return _own_dir[0]


def new_place(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one, for discard_since() to delete."""
    _written.append(f"{shared_dir(spark).rstrip('/')}/heron-{label}-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it back.

    Small partitions are written several to a file, one after the other, so they need no more memory.
    The session's settings are afterwards what they were.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    path = new_place(spark, label)
    most = max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_PER_FILE)
    rows = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS)
    try:
        df.coalesce(most).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody else looks for it
    finally:
        spark.conf.set(BATCH, rows)
    table = spark.read.schema(df.schema).parquet(path)
    table._heron_path = path
    return table


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for place in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = [p for p in _written if p not in set(paths)]


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, [table._heron_path])


def mark() -> int:
    """A point to which discard_since() goes back."""
    return len(_written)


def discard_since(spark: SparkSession, point: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the tables stored since mark(), but for `keep`: call it when no result that reads them is left to run."""
    _delete(spark, [p for p in _written[point:] if keep is None or p != keep._heron_path])


def release(spark: SparkSession) -> None:
    """Has the executors give back the heap that earlier work grew, before work whose memory is Python's.

    A collector keeps what it has grown to; a full collection shrinks it. One short task a core.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).write.format("noop").mode("overwrite").save()


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only. The fast branch is taken where lower() can change nothing else."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def heavy(counts: DataFrame, total: int) -> tuple[Column, DataFrame]:
    """Condition on `cnt` and the rows it holds for: fewer than HEAVY_PARTS, by construction."""
    cond = (F.col("cnt") * HEAVY_PARTS > F.lit(total)) & (F.col("cnt") > HEAVY_LEAST)
    return cond, counts.filter(cond)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """left joined to right, a stored table that is unique on keys and has `cnt`, the left rows of each key.

    Keys with over 1/HEAVY_PARTS of all `total` left rows number under HEAVY_PARTS, so their right
    rows are broadcast and the left rows stay where they are; all other keys are shuffled. Where no
    key is that heavy, this is a plain join.
    """
    cond, top = heavy(right, total)
    if top.isEmpty():
        return left.join(right, keys, how)
    marked = left.join(F.broadcast(top.select(*keys).withColumn("_hot", F.lit(True))), keys, "left")
    hot = left.join(F.broadcast(top), keys, "inner")
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot").join(right.filter(~cond), keys, how)
    return cold.unionByName(hot)
