"""Line numbers of text files that many tasks read, and CSV records with the line where each starts.

A file's splits are read apart; each counts its lines and quotes, and sums over the splits before it (a row a
split) make them line numbers, and tell whether a split starts inside quotes. So a record may hold line
breaks and cross splits, and no file is read by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean
from .files import cut


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value, and record: the line on which the CSV record starts that this line belongs to.

    The same on one task and on many. Quotes are double quotes; one that is never closed makes the rest of its
    file one record.
    """
    raw = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # written once, so that the order within a split, which only its reader knows, is kept
    rows = cut(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.monotonically_increasing_id().alias("at"), (quotes % 2).alias("odd")), "lines")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.sum("odd").alias("odd"))
    splits = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("odd_before"))
    here = Window.partitionBy("file", "split").orderBy("at")
    past = here.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(splits, ["file", "split"])
    line = F.col("lines_before") + F.row_number().over(here)
    inside = (F.col("odd_before") + F.coalesce(F.sum("odd").over(past), F.lit(0))) % 2 == 1
    rows = cut(rows.select("file", "split", "value", line.alias("line"), inside.alias("inside")), "numbered")
    start = F.max(F.when(~F.col("inside"), F.col("line"))).over(Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.where("not inside").groupBy("file", "split").agg(F.max("line").alias("last"))
    carried = rows.select("file", "split").distinct().join(last, ["file", "split"], "left").select("file", "split", F.max("last").over(before).alias("carried"))
    rows = rows.withColumn("start", start).join(carried, ["file", "split"])
    return rows.select("file", "line", "value", F.coalesce("start", "carried").alias("record"))


def read_csv_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV files, each with exactly this header (any case, byte-order mark allowed): the columns, file, line, ragged.

    line is where a record starts in its file. Empty lines are no records; a record with more or fewer
    fields is ragged.
    """
    lines = numbered_lines(spark, path)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    records = cut(lines.groupBy("file", F.col("record").alias("line")).agg(text.alias("text")), "records")
    heads = records.where("line = 1").select(F.lower(F.regexp_replace("text", "[\\x{FEFF}\\s\"]", "")).alias("h")).distinct().limit(2).collect()
    if [h["h"] for h in heads] != [",".join(columns).lower()]:
        raise ValueError(f"the header of {path} is not {','.join(columns)}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("_ragged", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_ragged", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    rows = records.where("line > 1 and trim(text) <> ''").select("file", "line", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return rows.select(*(clean(F.col(f"r.{c}")).alias(c) for c in columns), "file", "line", F.col("r._ragged").isNotNull().alias("ragged"))
