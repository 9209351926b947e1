"""Exact dedup by distributed MSD radix partitioning.

A text's key is its byte length followed by its bytes (white-space runs as one space). Each level
splits every open group by the next digit, a run of bytes that widens from level to level. Groups
of one leave, groups whose bytes have ended hold equal texts; no digest decides anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged, unused

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _split(rows: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """One level: rows (doc_id, sha, n, body, *keys) with their group after the next digit.

    The digit's groups are counted with map-side combining, so a group of any size reaches the
    join as one row; the join's large partitions are AQE's to split.
    """
    dealt = rows.withColumns({"digit": F.substring("body", 1, width), "rest": F.expr(f"substring(body, {width + 1})")}).drop("body")
    groups = (
        dealt.select(*keys, "n", "digit", "doc_id", F.monotonically_increasing_id().alias("rid"))
        .groupBy(*keys, "n", "digit")
        .agg(F.min("rid").alias("next"), F.count("*").alias("size"), F.min("doc_id").alias("lead"))
        .where("size > 1")
    )
    joined = dealt.join(groups, [*keys, "n", "digit"], "left")
    return joined.select(
        "doc_id", "sha", (F.col("n") - width).alias("n"), F.col("next").alias("grp"),
        F.coalesce("size", F.lit(1)).alias("size"), F.when(F.col("size") > 1, F.col("lead")).otherwise(F.col("doc_id")).alias("lead"),
        F.when((F.col("n") > width) & F.col("next").isNotNull(), F.col("rest")).alias("body"),
    )


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first_width: int = 56, growth: int = 16) -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty ones. Null doc_ids lose to any other; of rows that repeat the smallest
    doc_id with the same text, one is kept. Other columns are ignored. An empty table gives an empty one.
    """
    body = normalised(F.col(text)).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"))
    rows = rows.withColumns({"n": F.octet_length("body"), "sha": F.lit(None).cast("string")})
    # the first level reads the input twice rather than ship a digest beside every text
    dealt = rows.withColumn("digit", F.substring("body", 1, first_width))
    groups = (
        dealt.select("n", "digit", "doc_id", F.monotonically_increasing_id().alias("rid"))
        .groupBy("n", "digit")
        .agg(F.min("rid").alias("grp"), F.count("*").alias("size"), F.min("doc_id").alias("lead"))
        .where("size > 1")
    )
    joined = dealt.drop("sha").join(groups, ["n", "digit"], "left")
    level = staged(
        joined.select(
            "doc_id", F.sha2("body", 256).alias("sha"), (F.col("n") - first_width).alias("n"), "grp",
            F.coalesce("size", F.lit(1)).alias("size"), F.when(F.col("size") > 1, F.col("lead")).otherwise(F.col("doc_id")).alias("lead"),
            F.when((F.col("n") > first_width) & F.col("grp").isNotNull(), F.expr(f"substring(body, {first_width + 1})")).alias("body"),
        ),
        "exact",
    )
    done, width = [level.where("body is null")], first_width
    while not (open_rows := level.where("body is not null")).isEmpty():
        width *= growth
        level = staged(_split(open_rows.drop("size", "lead"), width, ["grp"]), "exact")
        done.append(level.where("body is null"))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    first = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("size"))
    return out.select(
        "doc_id", F.col("lead").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("lead")) & (first == 1)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns as they are, of which exact_groups keeps one for each text."""
    keep, sha, n = (unused(name, docs.columns) for name in ("keep", "sha", "n"))
    groups = exact_groups(docs, text, doc_id).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows = docs.withColumns({sha: F.sha2(normalised(F.col(text)).cast("binary"), 256), keep: F.col(doc_id).cast("long")})
    kept = rows.join(groups, rows[keep].eqNullSafe(groups["kept_id"]) & (rows[sha] == groups["kept_sha"]), "left_semi")
    order = Window.partitionBy(keep, sha).orderBy(F.lit(1))
    return kept.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*docs.columns)
