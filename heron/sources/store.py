"""A store of sites as bucketed tables: pages, seeds and attempts lie by domain and join where they are.

All tables of a store have the same number of buckets by the same column, so joins and groupings by it
need no exchange. Pages stay rows; nested documents are made on export only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from heron.session import folder


class SiteStore:
    """Bucketed tables by one column. Their files are in a folder of the shared one; names are the session's."""

    def __init__(self, spark: SparkSession, by: str = "domain", buckets: int = 16) -> None:
        self.spark, self.by, self.buckets, self.place, self.id = spark, by, buckets, folder(spark), uuid.uuid4().hex

    def name(self, table: str) -> str:
        return f"heron_{table}_{self.id}"

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Stores rows in the table's buckets, a file each, and gives the table."""
        dealt = rows.repartition(self.buckets, self.by)
        dealt.write.bucketBy(self.buckets, self.by).sortBy(self.by).option("path", f"{self.place}/{table}").mode("overwrite").saveAsTable(self.name(table))
        return self.table(table)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def drop(self) -> None:
        """Forgets the names; the files go with the folder."""
        for t in self.spark.catalog.listTables():
            if t.name.endswith(self.id):
                self.spark.sql(f"drop table {t.name}")
