"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule draws the source whose share of the cumulative weights holds frac(i * golden
ratio). The k-th slot of a source takes its k-th block of equal size from the source's documents, which
stand in shuffled order and begin again once all are taken.

Nothing here needs all sources, or all documents of a source, in one task: orders are range-partitioned
sorts, and ranks and running sums are taken within parts, then over the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: Points are matched with cumulative weights within so many equal parts of [0, 1), or one a source if there are more sources.
PARTS = 4096
#: A source's documents are summed in runs by the first four hexadecimal digits of their key, and these by the first two.
LOW, HIGH = 4, 2


def _numbered(rows: DataFrame, *order: Column, **sums: str) -> DataFrame:
    """rows with place (from 0, in the order over all rows) and, for name=column, the running sum of the column up to the row.

    The sort is range-partitioned; running values are per part, then over parts, of which there are no more
    than shuffle partitions.
    """
    tall = staged(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", 33))
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = tall.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"{name}_sum") for name, c in sums.items()))
    parts = parts.select("p", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", *(f"{name}_sum" for name in sums))))
    tall = tall.withColumns({"place": F.row_number().over(within) - 1} | {name: F.sum(c).over(within) for name, c in sums.items()})
    joined = tall.join(parts, tall["part"] == parts["p"])
    joined = joined.withColumns({"place": F.col("place") + F.col("n_before")} | {name: F.col(name) + F.col(f"{name}_sum_before") for name in sums})
    return joined.select(*rows.columns, "place", *sums)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to those with target: share of all sizes by weight, at most `most` times a source's size.

    Weights repeat over the sources by code point, null last. What a source can't take goes to the others
    by weight: rounds mark the sources that reach their limit at the present level until none is added.
    """
    rows = _numbered(sizes, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = staged(rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("limit")), "weighted")
    total = rows.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("weights")).first()
    pool, left, rest, before = float(share) * (total["n"] or 0), float(share) * (total["n"] or 0), float(total["weights"] or 1), 0
    while True:
        full = F.col("limit") <= F.col("weight") * F.lit(left) / F.lit(rest)
        now = rows.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("limit"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if now["n"] == before or not now["rest"]:
            break
        left, rest, before = pool - now["taken"], float(now["rest"]), now["n"]
    return rows.select("source", "source_size", F.when(full, F.col("limit")).otherwise(F.col("weight") * F.lit(left) / F.lit(rest)).alias("target"))


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """(source, source_size, target) to (source, source_size, target, slot, rank): each source's slots, in the order of the schedule.

    A source gets the slots that its target needs: what the schedule draws beyond them is dropped, what it
    is short of (a few slots a source, by the low discrepancy) follows after the last slot.
    """
    spark = plan.sparkSession
    whole = F.floor(F.floor("target") / F.col("source_size"))  # a source's last block may be short
    needed = whole * F.ceil(F.col("source_size") / block) + F.ceil((F.floor("target") - whole * F.col("source_size")) / block)
    live = plan.where("target >= 1").withColumn("needed", needed)
    live = staged(_numbered(live, F.col("source").isNull(), F.col("source"), upto="target"), "live")
    total, sources = live.agg(F.max("upto"), F.count("*")).first()
    length = int(-(-(total or 0) // block))
    parts = max(PARTS, sources)
    low, high = (F.col("upto") - F.col("target")) / F.lit(total), F.when(F.col("place") == sources - 1, F.lit(2.0)).otherwise(F.col("upto") / F.lit(total))
    live = live.withColumns({"low": low, "high": high})
    points = spark.range(length).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) % 1.0).alias("x"))
    points = points.withColumn("part", F.floor(F.col("x") * parts))
    covers = F.sequence(F.floor(F.col("low") * parts), F.least(F.floor(F.col("high") * parts), F.lit(parts - 1)))
    own = ["place", "source", "source_size", "target", "needed"]
    spans = live.select(*own, "low", "high", F.explode(covers).alias("part"))
    drawn = points.join(spans, "part").where("x >= low and x < high").select(F.col("place").alias("nth"), *own[1:], "slot")
    numbered = staged(_numbered(drawn, F.col("nth"), F.col("slot")), "numbered")
    counts = numbered.groupBy("nth").agg(F.min("place").alias("first"), F.count("*").alias("have"))
    ranked = numbered.join(counts, "nth").withColumn("rank", F.col("place") - F.col("first"))
    out = ["source", "source_size", "target", "slot", "rank"]
    slots = ranked.where(F.col("rank") < F.col("needed")).select(*out)
    short = live.join(counts.select(F.col("nth").alias("place"), "have"), "place", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < needed")
    short = short.select("source", "source_size", "target", "have", F.explode(F.sequence(F.col("have"), F.col("needed") - 1)).alias("rank"))
    return slots.union(short.withColumn("slot", F.lit(length) + F.col("rank") - F.col("have")).select(*out))


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows (rid, doc_id, source, size) with start: words of their source before them, in the order of md5(doc_id)."""
    rows = rows.withColumn("key", _key(F.col("doc_id"))).withColumns({"low": F.substring("key", 1, LOW), "high": F.substring("key", 1, HIGH)})
    source = F.struct(F.col("source").isNull(), "source")
    runs = rows.groupBy("source", "high", "low").agg(F.sum("size").alias("words"))
    tops = runs.groupBy("source", "high").agg(F.sum("words").alias("words"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    tops = tops.select(source.alias("s"), F.col("high").alias("h"), F.coalesce(F.sum("words").over(earlier("source", "high")), none).alias("before_high"))
    runs = runs.select(source.alias("s"), F.col("high").alias("h"), F.col("low").alias("l"), F.coalesce(F.sum("words").over(earlier("source", "high", "low")), none).alias("before_low"))
    runs = runs.join(tops, ["s", "h"]).select("s", "l", (F.col("before_high") + F.col("before_low")).alias("before"))
    within = Window.partitionBy("source", "low").orderBy("key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"upto": F.sum("size").over(within), "s": source})
    placed = placed.join(runs, (placed["s"] == runs["s"]) & (placed["low"] == runs["l"]))
    return placed.select("rid", "doc_id", "source", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))


def _pieces(rows: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """What each slot takes of rows (rid, doc_id, source, size): slot, source, rid, start (the document's words before it), words.

    Both sides are written first: the driver plans a query anew after each of its stages, and keeps those plans.
    """
    slots = schedule(plan, block)
    count = F.ceil(F.col("source_size") / block)
    taken_before = F.floor(F.col("rank") / count) * F.col("source_size") + F.col("rank") % count * block
    slots = slots.select(F.col("source").alias("s"), "slot", (F.col("rank") % count).alias("b"), F.least(F.lit(block), F.floor("target") - taken_before).alias("upto"))
    at = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    slots, placed = staged(slots.where("upto > 0"), "slots"), staged(_placed(rows).where("size > 0"), "placed")
    parts = placed.select("rid", "source", "start", "size", F.explode(at).alias("block"))
    hit = parts.join(slots, parts["source"].eqNullSafe(F.col("s")) & (parts["block"] == F.col("b")))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("upto"))
    hit = hit.withColumns({"from": low - F.col("start"), "words": high - low, "at": low})
    return hit.where("words > 0").select("slot", "source", "rid", "at", F.col("from").alias("start"), "words")


def _sized(docs: DataFrame) -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")


def _mixed(rows: DataFrame, block: int, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """rows (rid, doc_id, source, size) with source_size, target, taken and first_slot."""
    plan = staged(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    taken = _pieces(rows, plan, block).groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = rows.join(taken, "rid", "left")
    p = plan.select(F.col("source").alias("ps"), "source_size", "target")
    out = out.join(p, out["source"].eqNullSafe(p["ps"]))
    return out.select("rid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mix(docs: DataFrame, block: int = 1024, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Every row of docs (doc_id, source, text) with size, source_size, target, taken and first_slot.

    taken: words of the document in the blocks that the schedule draws; first_slot: the first slot that takes
    any, null if none does. Blocks run through a source's documents in the order of md5(doc_id); ties go by
    doc_id, then by size. A document of no words (null text, empty text) takes none. Rows that repeat count
    each; other columns are ignored; an empty table gives an empty one. The cut after a source's last drawn
    word makes each source take its target, rounded down to whole words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", _sized(docs))
    return _mixed(staged(rows, "mix"), block, weights, share, most).drop("rid")


def mixed_blocks(docs: DataFrame, block: int = 1024, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: slot, source, n_words, doc_ids, text of every slot of the schedule; sorted by slot it is the training order.

    A slot's text is `block` words (a source's last one may be short) of documents that follow each other in
    their source's shuffled order, joined by one space. Slots that follow the schedule's end may share a number.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text", _sized(docs)), "mix")
    narrow = rows.drop("text")
    plan = staged(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    pieces = _pieces(narrow, plan, block).join(rows.select("rid", "doc_id", words.alias("all")), "rid")
    part = F.struct("at", "doc_id", F.slice("all", (F.col("start") + 1).cast("int"), F.col("words").cast("int")).alias("words"))
    joined = pieces.select("slot", "source", part.alias("part")).groupBy("slot", "source").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    flat = F.flatten(F.col("parts.words"))
    return joined.select("slot", "source", F.size(flat).cast("long").alias("n_words"), F.col("parts.doc_id").alias("doc_ids"), F.array_join(flat, " ").alias("text"))


def repeat_taken(docs: DataFrame, block: int = 1024, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs, all columns, each as often as mix() takes it: taken / size, rounded up.

    Documents are never cut: the one in a source that is taken in part comes whole. A document without
    words (null or empty text) is taken by no block and goes. Rows that repeat are taken each for itself.
    """
    whole = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid"), _sized(docs)), "whole")
    rows = whole.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").alias("source"), "size")
    taken = _mixed(rows, block, weights, share, most).where("taken > 0").select("rid", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    out = whole.select("rid", "row").join(taken, "rid")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
