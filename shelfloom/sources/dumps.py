"""Bulk dumps and logs: text lines to typed rows, with a reason where a row can't be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators.quality import first_reason

WORK_KEY, EDITION_KEY = r"^/works/OL\d+W$", r"^/books/OL\d+M$"
SHELVES = ("Want to Read", "Currently Reading", "Already Read")


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of plain or gzip text files with a number that keeps their order within a file.

    A gzip file is one task; `partitions` deals its lines out right behind the scan. Many files scale better.
    """
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return lines.repartition(partitions) if partitions else lines


def dump_rows(lines: DataFrame) -> DataFrame:
    """lines (value, line_no) cut at the first four tabs: type, key, revision, last_modified, payload (variant), reject_reason."""
    fields = F.split("value", "\t", 5)
    kept = lines.where(F.trim("value") != "").withColumn("f", fields)
    part = lambda k: F.get("f", F.lit(k))
    rows = kept.select(
        "line_no", part(0).alias("type"), part(1).alias("key"), part(2).alias("revision"), part(3).alias("last_modified"),
        F.try_parse_json(part(4)).alias("payload"), F.size("f").alias("n"),
    )
    reason = first_reason([("malformed_dump_row", F.col("n") < 5), ("invalid_json", F.col("payload").isNull())])
    return rows.withColumn("reject_reason", reason).drop("n")


def field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("payload", f"$.{name}", kind)


def text_or_value(name: str) -> Column:
    """A text that is given plainly or as {value}."""
    return clean(F.coalesce(F.try_variant_get("payload", f"$.{name}.value", "string"), F.try_variant_get("payload", f"$.{name}", "string")))


def keys_of(name: str, path: str = "$.key") -> Column:
    """Distinct keys of a list of references, in their order."""
    values = F.try_variant_get("payload", f"$.{name}", "array<variant>")
    keys = F.transform(F.coalesce(values, F.array().cast("array<variant>")), lambda x: clean(F.try_variant_get(x, path, "string")))
    return F.array_distinct(F.filter(keys, lambda x: x.isNotNull()))


#: Why a line of a works dump is no work, in the order in which a reason is looked for.
WORK_REASONS = ("malformed_dump_row", "invalid_json", "wrong_record_type", "malformed_row", "invalid_key", "missing_title")


def work_rows(dump: DataFrame) -> DataFrame:
    """Dump rows as works; later reasons are for rows that parse but aren't works."""
    is_object = F.coalesce(F.startswith(F.schema_of_variant("payload"), F.lit("OBJECT")), F.lit(False))
    covers = F.filter(F.coalesce(field("covers", "array<bigint>"), F.array().cast("array<bigint>")), lambda x: x > 0)
    rows = dump.withColumn("is_object", is_object).select(
        "line_no", "type", "key", F.col("revision").try_cast("bigint").alias("revision"), clean(field("title")).alias("title"), clean(field("subtitle")).alias("subtitle"),
        keys_of("authors", "$.author.key").alias("author_keys"), keys_of("subjects", "$").alias("subjects"), F.array_distinct(covers).alias("cover_ids"),
        clean(field("first_publish_date")).alias("first_publish_date"), text_or_value("description").alias("description"), "is_object", "reject_reason",
    )
    reason = first_reason([
        ("wrong_record_type", F.col("type") != "/type/work"), ("malformed_row", ~F.col("is_object") | F.col("revision").isNull()),
        ("invalid_key", ~F.regexp_like("key", F.lit(WORK_KEY))), ("missing_title", F.col("title").isNull()),
    ])
    return rows.withColumn("reject_reason", F.coalesce("reject_reason", reason)).drop("is_object")


def latest_revision(rows: DataFrame) -> DataFrame:
    """One row a key: the highest revision, the later line among equals."""
    best = F.max_by(F.struct(*rows.columns), F.struct("revision", "line_no"))
    return rows.groupBy("key").agg(best.alias("row")).select("row.*")


def signal_rows(lines: DataFrame) -> DataFrame:
    """Log lines of exactly four fields: work_key, edition_key, value, event_date, reject_reason."""
    f = F.transform(F.split("value", "\t", -1), lambda x: F.trim(x))
    part = lambda k: F.get("f", F.lit(k))
    rows = lines.where(F.trim("value") != "").withColumn("f", f)
    shaped = (
        (F.size("f") == 4) & F.regexp_like(part(0), F.lit(WORK_KEY)) & (F.regexp_like(part(1), F.lit(EDITION_KEY)) | (part(1) == "\\N"))
        & F.regexp_like(part(3), F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    )
    out = rows.withColumn("reject_reason", F.when(~F.coalesce(shaped, F.lit(False)), "malformed_row"))
    return out.select(part(0).alias("work_key"), part(1).alias("edition_key"), part(2).alias("value"), part(3).alias("event_date"), "reject_reason")


def rating_reason(value: Column) -> Column:
    return F.when(~F.regexp_like(value, F.lit(r"^-?\d+$")), "non_integer").when(~value.try_cast("int").between(1, 5), "out_of_range")


def shelf_reason(value: Column) -> Column:
    return F.when(~value.isin(*SHELVES), "unknown_shelf")


def author_rows(dump: DataFrame) -> DataFrame:
    """Dump rows as (key, name, reject_reason)."""
    rows = dump.select("type", "key", clean(field("name")).alias("name"), "reject_reason")
    reason = first_reason([("wrong_record_type", F.col("type") != "/type/author"), ("missing_name", F.col("name").isNull())])
    return rows.select("key", "name", F.coalesce("reject_reason", reason).alias("reject_reason"))


def author_names(authors: DataFrame) -> DataFrame:
    """One row a key: its name, or null if the dump has different ones."""
    names = authors.groupBy("key").agg(F.min("name").alias("low"), F.max("name").alias("high"))
    return names.select("key", F.when(F.col("low") == F.col("high"), F.col("low")).alias("name"))


def exclusion_keys(lines: DataFrame) -> DataFrame:
    """One key a line, without byte-order mark and blank lines; keys that don't look like works are dropped with a reason."""
    key = F.trim(F.regexp_replace("value", "\\x{FEFF}", ""))
    rows = lines.select(key.alias("work_key")).where("work_key <> ''").distinct()
    return rows.withColumn("reject_reason", F.when(~F.regexp_like("work_key", F.lit(WORK_KEY)), "invalid_key"))
