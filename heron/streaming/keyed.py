"""A stored table with one place for each key, merged batch by batch.

Rows lie in buckets by the hash of their key. A merge reads and rewrites only the buckets that its
rows touch (copy on write), and becomes visible by one new file in the log, which names the folder
of each bucket and the last batch of each writer. So readers see the table before or after a merge,
a merge that was lost on the way leaves files that nothing names, and a batch that is run again
changes nothing. One writer at a time; files that nothing names any more go with `vacuum`.

Cases: a merge of no rows makes no version but notes its batch; null keys are a key of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """A table in a shared folder. schema: DDL of all columns; key: columns that name a row's bucket."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def state(self) -> dict:
        """The newest entry of the log: version, folder of each bucket, last batch of each writer."""
        found = [n for n in self._names("log") if n.endswith(".json")]
        if not found:
            return {"version": 0, "buckets": {}, "batches": {}}
        path = self._path(f"log/{found[-1]}")
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        name = f"log/{state['version']:012d}.json"
        path, fresh = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(fresh)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(fresh, path):
            raise RuntimeError(f"{self.folder} has another writer: version {state['version']} is there")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _held(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        return self._held(list(self.state()["buckets"].values()))

    def merge(self, rows: DataFrame, combine: Combine, writer: str = "", batch: int | None = None) -> int:
        """Rewrites the buckets that rows touch as combine(what they hold, rows); the version then. A batch of a writer counts once."""
        state = self.state()
        if batch is not None and batch <= state["batches"].get(writer, -1):
            return state["version"]
        touched = [r[0] for r in rows.select(self.bucket()).distinct().collect()]  # as many as there are buckets, at most
        if touched:
            old = self._held([state["buckets"][str(b)] for b in touched if str(b) in state["buckets"]])
            new = combine(old, rows).select(*self.schema.names).withColumn("_bucket", self.bucket())
            place = f"data/{uuid.uuid4().hex}"
            new.repartition(min(len(touched), self.spark.sparkContext.defaultParallelism), "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{place}")
            left = {k: v for k, v in state["buckets"].items() if int(k) not in touched}
            state["buckets"] = left | {n.split("=")[1]: f"{place}/{n}" for n in self._names(place) if n.startswith("_bucket=")}
        elif batch is None:
            return state["version"]
        if batch is not None:
            state["batches"][writer] = batch
        state["version"] += 1
        self._commit(state)
        return state["version"]

    def clear(self) -> int:
        """Empties the table; how many rows it had."""
        state, n = self.state(), self.read().count()
        self._commit(state | {"version": state["version"] + 1, "buckets": {}})
        return n

    def vacuum(self) -> int:
        """Deletes what the newest version doesn't name: call it when nothing reads an older one. How many folders went."""
        state = self.state()
        used = {f.split("/")[1] for f in state["buckets"].values()}
        gone = [f"data/{n}" for n in self._names("data") if n not in used] + [f"log/{n}" for n in self._names("log") if n != f"{state['version']:012d}.json"]
        for name in gone:
            path = self._path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)


def into(stream: DataFrame, table: KeyedTable, combine: Combine, state_folder: str, writer: str) -> None:
    """Runs a stream over all that is there, batch by batch, into the table."""
    query = stream.writeStream.foreachBatch(lambda rows, n: table.merge(rows, combine, writer, n)).option("checkpointLocation", state_folder).trigger(availableNow=True).start()
    query.awaitTermination()
