"""Tables dealt into buckets by key: an upsert rewrites the buckets that it touches and no other file."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import delete_tree, scratch_dir

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """A table of numbered versions below `path`, with rows of `schema` in `buckets` buckets by hash of `key`.

    A version is a manifest: for each bucket the folder that holds it. An upsert writes new folders for the
    buckets of its rows, and the manifest as the last step, in one commit; a job that dies before leaves the
    version before it. Of older versions `keep` stay, others' manifests and folders go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.schema, self.key, self.buckets, self.keep = spark, path, schema, key, buckets, keep
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("bucket int, folder string, version long").parquet(f"{self.path}/manifests")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def last_version(self, before: int | None = None) -> int | None:
        """The newest version, or the newest one before another; None if there is none."""
        found = self._manifests()
        if found is None:
            return None
        return found.where(F.lit(True) if before is None else F.col("version") < before).agg(F.max("version")).first()[0]

    def folders(self, version: int | None) -> dict[int, str]:
        """Bucket to folder: at most one for each bucket, so of a bounded number."""
        if version is None:
            return {}
        rows = self._manifests().where((F.col("version") == version) & (F.col("bucket") >= 0)).collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version (the newest, if none is named), or of some of its buckets."""
        folders = self.folders(self.last_version() if version is None else version)
        return self._rows([f for b, f in sorted(folders.items()) if only is None or b in only])

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets that rows fall into."""
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def upsert(self, rows: DataFrame, merge: Merge, version: int | None = None) -> int:
        """A new version: `merge` gets the old rows of the touched buckets and the new rows, and gives the buckets' rows.

        A version that is named and written again (a batch that runs twice) starts from the one before it and
        comes out the same.
        """
        base = self.last_version(version)
        if version is None:
            version = 0 if base is None else base + 1
        folders = self.folders(base)
        scratch = scratch_dir(self.spark, "upsert")
        rows.withColumn("__bucket", self.bucket()).write.parquet(scratch)
        new = self.spark.read.parquet(scratch)
        touched = {r[0] for r in new.select("__bucket").distinct().collect()}
        if touched:
            old = self._rows([folders[b] for b in sorted(touched & folders.keys())])
            merged = merge(old, new.drop("__bucket")).select(*self.columns).withColumn("__bucket", self.bucket())
            data = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
            merged.repartition("__bucket").sortWithinPartitions("__bucket", *self.key).write.partitionBy("__bucket").parquet(data)
            written = {r[0] for r in self.spark.read.parquet(data).select("__bucket").distinct().collect()} if not merged.isEmpty() else set()
            folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{data}/__bucket={b}" for b in written}
        written_before = set(self.folders(version).values()) if base is not None or self._manifests() is not None else set()
        line = [(b, f) for b, f in sorted(folders.items())] or [(-1, "")]
        self.spark.createDataFrame(line, "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")
        delete_tree(self.spark, scratch)
        self._forget(version, written_before)
        return version

    def _forget(self, version: int, written_before: set[str]) -> None:
        """Deletes manifests before the last `keep`, and folders that only they, or this version as it was before, name."""
        rows = self._manifests().collect()  # keep + 1 versions of a row a bucket
        versions = sorted({r["version"] for r in rows if r["version"] <= version})
        gone = set(versions[: -self.keep])
        named = {r["folder"] for r in rows if r["version"] not in gone}
        for v in gone:
            delete_tree(self.spark, f"{self.path}/manifests/version={v}")
        for folder in (written_before | {r["folder"] for r in rows if r["version"] in gone and r["folder"]}) - named:
            delete_tree(self.spark, folder)
