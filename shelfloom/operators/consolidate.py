"""Equivalent works and repeated editions of provider candidates: the best of each group, and all its members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import editions as ed
from ..functions.isbn import isbn13
from .matching import completeness, edition_quality, work_quality


def _best(rows: DataFrame, keys: list[str], quality: list[Column], tie: str) -> DataFrame:
    """One row a group: the highest quality, compared part by part, ties by smallest `tie`; members counts the group.

    One mergeable aggregate: each task keeps one candidate a group, so that a group of any size moves as few rows.
    """
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct(*((-part).alias(f"p{k}") for k, part in enumerate(quality)), F.col(tie).alias("tie"))
    found = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("best"), F.count("*").alias("members"))
    return found.select(*keys, "best.*", "members")


def _work_parts() -> list[Column]:
    parts = work_quality()
    return [parts[name] for name in ("edition", "isbns", "languages", "covers", "subjects", "years", "descriptions")]


def group_works(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with group_key: equal `keys` (what a match says of title and author) are one work.

    A candidate known to be in other languages only stays on its own.
    """
    languages = F.coalesce("languages", F.array().cast("array<string>"))
    foreign = (F.size(languages) > 0) & ~F.coalesce(ed.names_english(languages), F.lit(False))
    same = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return candidates.withColumn("group_key", F.when(foreign, F.concat(F.lit("non_english|"), F.col("id").cast("string"))).otherwise(same))


def consolidate_works(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One representative of each group of equivalent works, with how many members and which work ids the group has.

    candidates: id, work_id, edition_id, the lists of WORK_PARTS and `keys`. The representative has the best
    quality in seven parts, compared in their order, ties by id. Groups' ids are distinct and sorted.
    """
    grouped = group_works(candidates, keys)
    best = _best(grouped, ["group_key"], _work_parts(), "id")
    ids = grouped.groupBy("group_key").agg(F.array_sort(F.collect_set("work_id")).alias("work_ids"))
    return best.join(ids, "group_key", "left")


def work_members(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(group_key, id, place): every member of each group, best first."""
    grouped = group_works(candidates, keys)
    order = Window.partitionBy("group_key").orderBy(*(p.desc() for p in _work_parts()), "id")
    return grouped.select("group_key", "id", F.row_number().over(order).alias("place"))


def edition_identity() -> Column:
    """What makes two candidates one edition of a provider: its edition id, else its lowest valid ISBN, else the candidate itself."""
    provider = F.coalesce("provider", F.lit("unknown"))
    isbn = F.array_min(F.filter(F.transform(F.coalesce("isbns", F.array().cast("array<string>")), isbn13), lambda x: x.isNotNull()))
    rest = F.when(F.col("edition_id").isNotNull(), F.concat(F.lit(":edition:"), F.col("edition_id"))).when(isbn.isNotNull(), F.concat(F.lit(":isbn:"), isbn)).otherwise(F.concat(F.lit(":candidate:"), F.col("id").cast("string")))
    return F.concat(provider, rest)


def consolidate_editions(candidates: DataFrame) -> DataFrame:
    """One candidate of each edition identity: the one with most of eight parts (EDITION_PARTS), ties by id; members counts them.

    candidates: id, provider, edition_id, isbns and the lists of EDITION_PARTS.
    """
    return _best(candidates.withColumn("identity", edition_identity()), ["identity"], [edition_quality()], "id")


def metadata_completeness(latest_year: int) -> Column:
    """The eight parts of an edition that is scored: the title, six lists, and a year from 1000 to latest_year + 1."""
    lists = ("authors", "languages", "publishers", "formats", "covers", "descriptions")
    years = F.filter(F.coalesce("years", F.array().cast("array<int>")), lambda y: y.between(1000, latest_year + 1))
    return completeness([F.coalesce(F.trim("title"), F.lit("")) != "", *(F.coalesce(F.size(c), F.lit(0)) > 0 for c in lists), F.size(years) > 0])
