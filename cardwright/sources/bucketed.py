"""The service's tables as Spark's own bucketed tables: joins by key need no exchange, and inserts into several tables show at once or not at all.

Rows carry the batch that they came with. A batch is visible once its row stands in the table of commits, which is written after all tables; the rows of an insert that failed
on the way are never seen, and ``swept`` leaves them out when a table is written anew. Writing a table is Spark's own append, so a task that fails or runs twice adds nothing.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"


@dataclass(frozen=True)
class Tables:
    """Bucketed tables under ``path``, called ``prefix`` and their names in the catalogue; ``keys`` has the column by which each is dealt, the same number of buckets each."""

    spark: SparkSession
    path: str
    keys: dict[str, str]
    buckets: int = 8
    prefix: str = "cardwright"

    def _full(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def _append(self, name: str, rows: DataFrame) -> None:
        writer = rows.repartition(self.buckets, self.keys[name]) if name in self.keys else rows.coalesce(1)
        out = writer.write.format("parquet").mode("append").option("path", f"{self.path}/{name}")
        (out.bucketBy(self.buckets, self.keys[name]).sortBy(self.keys[name]) if name in self.keys else out).saveAsTable(self._full(name))

    def _commits(self) -> DataFrame | None:
        return self._read("commits") if self.spark.catalog.tableExists(self._full("commits")) else None

    def _read(self, name: str) -> DataFrame:
        self.spark.catalog.refreshTable(self._full(name))  # another session may have written, as streams do
        return self.spark.table(self._full(name))

    def insert(self, rows: dict[str, DataFrame], tag: str | None = None) -> str | None:
        """Rows for one or more tables, all or nothing; returns the batch. The order of columns does not matter, names do.

        A ``tag`` counts once: rows under a tag that was inserted before are left out, and None is returned. One writer at a time uses a tag.
        """
        unknown = set(rows) - set(self.keys)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        if tag is not None and self._commits() is not None and not self._commits().where(F.col("tag") == tag).isEmpty():
            return None
        batch = uuid.uuid4().hex
        for name, df in rows.items():
            self._append(name, df.withColumn(BATCH, F.lit(batch)))
        self._append("commits", self.spark.createDataFrame([(batch, tag)], f"{BATCH} string, tag string"))
        return batch

    def scan(self, name: str) -> DataFrame:
        """The visible rows of a table. Commits are a row an insert, so Spark joins them by broadcast while they are small; the table itself is not exchanged."""
        if (commits := self._commits()) is None:
            raise ValueError("nothing was inserted yet")
        return self._read(name).join(commits, BATCH, "left_semi").drop(BATCH)

    def lookup(self, name: str, value: int | str) -> DataFrame:
        """The rows of a key; only the bucket that may hold them is read."""
        return self.scan(name).where(F.col(self.keys[name]) == value)

    def where(self, name: str, *conditions: Column) -> DataFrame:
        """Rows for which all conditions hold; one that is null does not."""
        out = self.scan(name)
        for condition in conditions:
            out = out.where(condition)
        return out

    def swept(self, name: str, to: "Tables") -> None:
        """The visible rows of a table as one batch of another set of tables."""
        to.insert({name: self.scan(name)})

    def drop(self) -> None:
        for name in (*self.keys, "commits"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._full(name)}")
