"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir(spark.sparkContext.applicationId)


@cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="shelfloom-")


#: Folders of tables that staged() wrote and nobody has deleted yet, by application, each with the table that reads it
#: while somebody else holds that: a register must not keep plans in the driver's memory.
_written: dict[str, dict[str, weakref.ref[DataFrame]]] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back, so that later jobs neither recompute it nor depend on an executor.

    The table stays until discard() or release(): results are read lazily and may still need it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = _written.setdefault(spark.sparkContext.applicationId, {})
    own[path] = weakref.ref(df)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    own[path] = weakref.ref(table)
    return table


def _delete(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written[spark.sparkContext.applicationId].pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: a loop's last round, once the next one is written."""
    for df in tables:
        own = _written.get(df.sparkSession.sparkContext.applicationId, {})
        _delete(df.sparkSession, {path for path, table in own.items() if table() is df})


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end: for a step whose result is written inside, so that nothing needs it any more."""
    own = _written.setdefault(spark.sparkContext.applicationId, {})
    before = set(own)
    try:
        yield
    finally:
        _delete(spark, set(own) - before)


def release(spark: SparkSession) -> int:
    """Delete all that this session's operators staged and still lies there, after their results are written; how many tables."""
    paths = set(_written.get(spark.sparkContext.applicationId, {}))
    _delete(spark, paths)
    return len(paths)


def unused(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
