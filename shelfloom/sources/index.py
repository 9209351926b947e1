"""A catalogue snapshot as bucketed, sorted tables: records, and pointers to them by ISBN and by title and author.

Joins on a table's key read it as it lies, without a shuffle of the indexed side, and a lookup of few keys
reads the buckets of those keys only, and in them the row groups that statistics and Bloom filters leave.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.isbn import isbn13
from ..functions.text import work_identity

RECORDS, ISBNS, WORKS = "records", "isbns", "works"
KEYS = {RECORDS: "record_key", ISBNS: "isbn13", WORKS: "work"}


def record_key(columns: list[str]) -> Column:
    """A record's digest over its columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class SnapshotIndex:
    """The tables of an index: `prefix` and a kind name a table of the session, which lies below `path`."""

    spark: SparkSession
    path: str
    prefix: str
    buckets: int = 64

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{kind}")

    def _write(self, kind: str, rows: DataFrame, rows_a_group: int) -> None:
        key = KEYS[kind]
        # one task writes one bucket, so that a bucket is one sorted file
        out = rows.repartition(self.buckets, key).sortWithinPartitions(key).write.mode("overwrite").option("path", f"{self.path}/{kind}")
        out = out.option("parquet.bloom.filter.enabled#" + key, "true").option("parquet.block.row.count.limit", rows_a_group)
        out.bucketBy(self.buckets, key).sortBy(key).saveAsTable(f"{self.prefix}_{kind}")

    def build(self, candidates: DataFrame, rows_a_group: int = 20_000) -> SnapshotIndex:
        """candidates (isbn13, title, author and more) as records, each different one once, and the pointers to them."""
        columns = candidates.columns
        records = candidates.withColumn("record_key", record_key(columns)).dropDuplicates(["record_key"])
        self._write(RECORDS, records, rows_a_group)
        kept = self.table(RECORDS)
        self._write(ISBNS, kept.select(isbn13(F.col("isbn13")).alias("isbn13"), "record_key").where("isbn13 is not null"), rows_a_group)
        work = work_identity(F.col("title"), F.col("author"))
        self._write(WORKS, kept.select(work.alias("work"), "record_key").where("work is not null"), rows_a_group)
        return self

    def opened(self) -> SnapshotIndex:
        """The index in another session: its tables are named again, nothing is read."""
        for kind, key in KEYS.items():
            schema = self.spark.read.parquet(f"{self.path}/{kind}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"create table if not exists {self.prefix}_{kind} ({columns}) using parquet options (path '{self.path}/{kind}') clustered by ({key}) sorted by ({key}) into {self.buckets} buckets")
        return self

    def drop(self) -> None:
        for kind in KEYS:
            self.spark.sql(f"drop table if exists {self.prefix}_{kind}")

    def by_isbn(self, isbn: str) -> DataFrame:
        """The records of one ISBN: one bucket of pointers is read, then one of records a pointer."""
        found = [r["record_key"] for r in self.table(ISBNS).where(F.col("isbn13") == isbn).limit(1_000).collect()]
        return self.table(RECORDS).where(F.col("record_key").isin(found))

    def links(self, sources: DataFrame) -> DataFrame:
        """sources (key, isbn, title, author) to (key, method, value, n): the values that have records, and how many.

        The records of a value are the index's pointers, so that a common work makes no pairs of sources and
        records; `members` has them for the values that are asked for.
        """
        out = None
        for kind, value in ((ISBNS, isbn13(F.col("isbn"))), (WORKS, work_identity(F.col("title"), F.col("author")))):
            key = KEYS[kind]
            counts = self.table(kind).groupBy(key).agg(F.count("*").alias("n"))
            mine = sources.select("key", value.alias(key)).where(f"{key} is not null")
            rows = mine.join(counts, key).select("key", F.lit(kind).alias("method"), F.col(key).alias("value"), "n")
            out = rows if out is None else out.unionByName(rows)
        return out

    def members(self, links: DataFrame) -> DataFrame:
        """(method, value, record_key): the pointers of the values that links name, each once."""
        out = None
        for kind in (ISBNS, WORKS):
            wanted = links.where(F.col("method") == kind).select(F.col("value").alias(KEYS[kind])).distinct()
            rows = self.table(kind).join(wanted, KEYS[kind], "left_semi").select(F.lit(kind).alias("method"), F.col(KEYS[kind]).alias("value"), "record_key")
            out = rows if out is None else out.unionByName(rows)
        return out
