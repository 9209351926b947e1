"""Reasons for rejection, their counts, and checks of a table's constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first rule whose condition holds; null if none does. A null condition doesn't hold."""
    out = F.when(rules[0][1], rules[0][0])
    for code, condition in rules[1:]:
        out = out.when(condition, code)
    return out


def all_reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """The codes of all rules whose condition holds, in the order of the rules."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules)), lambda x: x.isNotNull())


def reason_counts(rows: DataFrame, codes: Sequence[str], column: str = "reject_reason") -> DataFrame:
    """Rows per code, zeros included; `accepted` counts rows without one."""
    names = rows.sparkSession.createDataFrame([(c,) for c in [*codes, "accepted"]], "reason string")
    counts = rows.groupBy(F.coalesce(column, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
    return names.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def write_counted(rows: DataFrame, path: str, codes: Sequence[str], column: str = "reject_reason") -> DataFrame:
    """Writes the rows without a reason, and gives (reason, n) of all, counted in the pass that writes; zeros included.

    Fails if the counts of `codes` and of accepted rows don't make up the input: a reason that isn't listed.
    """
    seen = Observation()
    counts = [F.count("*").alias("input"), F.count_if(F.col(column).isNull()).alias("accepted"), *(F.count_if(F.col(column) == c).alias(c) for c in codes)]
    rows.observe(seen, *counts).where(F.col(column).isNull()).drop(column).write.parquet(path)
    found = seen.get
    if found["input"] != found["accepted"] + sum(found[c] for c in codes):
        raise ValueError(f"{found['input']} rows are not the sum of {found}")
    return rows.sparkSession.createDataFrame([(name, found[name]) for name in [*codes, "accepted"]], "reason string, n long")


def counts_by(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(by, value, n): rows by each of the columns, all in one pass of grouping sets."""
    sets = rows.groupingSets([[F.col(c)] for c in columns], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"_{c}") for c in columns))
    by, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        by, value = F.when(F.col(f"_{c}") == 0, c).otherwise(by), F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return sets.select(by.alias("by"), value.alias("value"), "n")


def broken_rules(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(rule, n): how many rows break each rule, all rules in one pass."""
    counts = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(code) for code, c in rules))
    pairs = F.array(*(F.struct(F.lit(code).alias("rule"), F.col(code).alias("n")) for code, _ in rules))
    return counts.select(F.inline(pairs))


def duplicate_groups(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """(value, member, n): a row for each row whose key others have too, with how many they are.

    Counts are combined before the shuffle and joined back, so that a common key is never one task's array.
    """
    keyed = rows.where(key.isNotNull()).select(key.alias("value"), F.col(member).alias("member"))
    counts = keyed.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(counts, "value")


def language_digest(works: DataFrame, snapshot: str) -> DataFrame:
    """One digest over a snapshot's name and each work (work_key, languages) with its languages in order, whatever the order of the rows."""
    rows = works.select("work_key", F.array_sort(F.coalesce("languages", F.array().cast("array<string>"))).alias("languages"))
    return fingerprint(rows, "work_key", ["work_key", "languages"]).select(F.sha2(F.concat_ws("\n", F.lit(snapshot), "fingerprint"), 256).alias("digest"))


def fingerprint(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One digest of all rows, whatever their order.

    Digests of rows are joined by key and digested in blocks of keys whose own digests begin alike, in eight
    digits, then four, then none: a block is small for up to 10**14 rows, and none but the last is one task.
    """
    each = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    level = rows.select(F.sha2(F.col(key).cast("string"), 256).alias("part"), F.col(key).alias("key"), each.alias("digest"))
    for digits in (8, 4, 0):
        inside = F.transform(F.array_sort(F.collect_list(F.struct("key", "digest"))), lambda x: x["digest"])
        level = level.groupBy(F.substring("part", 1, digits).alias("part")).agg(F.sha2(F.array_join(inside, "\n"), 256).alias("digest")).withColumn("key", F.col("part"))
    return level.select(F.col("digest").alias("fingerprint"))
