"""CSV, NDJSON and artifact files with closed schemas, and the sinks that publish them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import strict_day
from ..functions.editions import https_host
from ..functions.isbn import isbn13
from ..functions.text import clean
from ..operators.quality import all_reasons


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file whose header has exactly these columns (any case, byte-order mark allowed); ragged rows are marked."""
    head = spark.read.text(path).limit(1).select(F.lower(F.regexp_replace("value", "[\\x{FEFF}\\s\"]", "")).alias("h")).first()
    if head is None or head["h"].split(",") != [c.lower() for c in columns]:
        raise ValueError(f"the header of {path} is not {','.join(columns)}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("_ragged", T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("multiLine", True)
    rows = reader.option("columnNameOfCorruptRecord", "_ragged").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.select(*(clean(F.col(c)).alias(c) for c in columns), F.col("_ragged").isNotNull().alias("ragged"))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType, strict: bool) -> DataFrame:
    """Strict: the first bad line fails the job. Otherwise it becomes a row of nulls with its text in _corrupt."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_artifact(spark: SparkSession, path: str, schema: T.StructType, rows: str) -> DataFrame:
    """The rows of one JSON document whose top-level keys are exactly the schema's."""
    found = spark.read.option("multiLine", True).json(path)
    if set(found.columns) != set(schema.fieldNames()):
        raise ValueError(f"{path} has the keys {sorted(found.columns)}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline(rows))


def catalog_errors(rows: DataFrame) -> DataFrame:
    """title, author, isbn rows with all their errors."""
    return rows.withColumn("errors", all_reasons([
        ("ragged_row", F.col("ragged")), ("missing_title", F.col("title").isNull()), ("missing_author", F.col("author").isNull()),
        ("missing_isbn", F.col("isbn").isNull()), ("invalid_isbn", F.col("isbn").isNotNull() & isbn13(F.col("isbn")).isNull()),
    ]))


def release_errors(rows: DataFrame, first: str = "2025-01-01", last: str = "2027-12-31") -> DataFrame:
    """Release rows with all their errors: ISBN, date in range, https links, one to three different genres."""
    genres = F.filter(F.transform(F.split("genres", ";"), lambda x: F.trim(x)), lambda x: x != "")
    day = strict_day(F.col("publicationDate"))
    out = rows.withColumn("genre_list", genres)
    return out.withColumn("errors", all_reasons([
        ("missing_title", F.col("title").isNull()), ("missing_author", F.col("author").isNull()), ("invalid_isbn", F.coalesce(isbn13(F.col("isbn")), F.lit("")) == ""),
        ("invalid_date", day.isNull()), ("date_out_of_range", ~day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))),
        ("invalid_cover_url", https_host(F.col("coverImageUrl")).isNull()), ("invalid_source_url", https_host(F.col("sourceUrl")).isNull()),
        ("genre_count", ~F.size("genre_list").between(1, 3)), ("repeated_genre", F.size(F.array_distinct("genre_list")) < F.size("genre_list")),
    ]))


def publication_date_errors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("errors", all_reasons([
        ("invalid_isbn", F.coalesce(isbn13(F.col("isbn")), F.lit("")) == ""), ("invalid_date", strict_day(F.col("publicationDate")).isNull()),
        ("invalid_source_url", https_host(F.col("sourceUrl")).isNull()),
    ]))


def canonical_json(columns: list[str]) -> Column:
    """Columns as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)))


def write_index(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Distinct rows, dealt by key and sorted in each file, so that a lookup reads few row groups."""
    rows.dropDuplicates().repartition(parts, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def publish(rows: DataFrame, path: str, expected: int | None = None) -> int:
    """Write a new version beside the others, read it back, and only then name it the current one.

    A version is current once its line is in the folder of current versions, which is written as one
    commit: a job that dies before leaves the version before it in place.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/versions/{version}")
    n = spark.read.schema(rows.schema).parquet(f"{path}/versions/{version}").count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows were written to {path}/versions/{version}, not {expected}; the version before stays current")
    line = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"), F.lit(n).alias("n"))
    line.coalesce(1).write.mode("append").parquet(f"{path}/current")
    return n


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of what publish() wrote."""
    last = spark.read.parquet(f"{path}/current").agg(F.max_by("version", F.struct("published_at", "version"))).first()[0]
    return spark.read.parquet(f"{path}/versions/{last}")


def write_report(rows: DataFrame, path: str) -> int:
    """Rows as JSON lines, read back and compared; how many. Nulls are written, so that every line has every field."""
    rows.write.option("ignoreNullFields", False).json(path)
    wrong = differences(rows, rows.sparkSession.read.schema(rows.schema).json(path)).count()
    if wrong:
        raise ValueError(f"{wrong} rows of {path} are not as they were written")
    return rows.sparkSession.read.text(path).count()


def differences(plan: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the plan that are missing and rows that it doesn't have; empty after a complete run."""
    missing = plan.exceptAll(found.select(plan.columns)).withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select(plan.columns).exceptAll(plan).withColumn("side", F.lit("unexpected")))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; a temporary one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shelfloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_tree(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(rows: DataFrame, name: str) -> DataFrame:
    """rows written once to the shared folder and read back: what follows is planned on its own."""
    path = scratch_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
