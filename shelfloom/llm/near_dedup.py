"""Near-duplicates by MinHash, banding, verification on whole shingle sets, and connected components.

Documents with the same set are one class, and its first document stands for it. Classes that share a
band's bucket are candidates. Instead of all pairs of a bucket, rounds link its members to one of them,
verify those pairs, and join what is linked; only members of one bucket that are then still in different
components are compared with one another. So a bucket costs about as many pairs as it has members, and
every pair of a bucket is either verified or already connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .storage import discard, staged, unused
from .words import Words, slices, texts_of

BANDS, ROWS, MINIMA = 30, 5, 600
#: Members of a centre that one task verifies at a time; members of a bucket's block that are compared in one task.
GROUP, BLOCK = 512, 1024
#: Pairs are verified if this share of their minima's low bytes agree: 0.8 less four standard deviations.
LEAST_ESTIMATE = 0.735
#: Texts to verify are looked for by the low bits of their row's hash: at most this many rows are broadcast.
BUCKETS = 1 << 22


def _minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """For each set, `count` minima of multiply-shift hashes of its shingles' upper halves."""
    rng = np.random.default_rng(3)
    factors = (rng.integers(0, 1 << 31, count, np.uint32) << np.uint32(1)) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, count, np.uint32)
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(sizes)
    for part in np.array_split(some, max(1, int(sizes.sum()) // 100_000)):
        if len(part):
            x = (np.concatenate([sets[k] for k in part]) >> np.uint64(32)).astype(np.uint32)
            first = np.cumsum(sizes[part]) - sizes[part]
            for k in range(count):
                out[part, k] = np.minimum.reduceat(x * factors[k] + shifts[k], first)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """docs (rid, doc_id, text, *) to rid, doc_id, text, n_shingles, digest of the set, low bytes of the minima, a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 1_000_000):
                sets = Words(texts_of(batch, 2)).shingles(size)
                minima = _minima(sets, MINIMA)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                rows = [np.frombuffer(b"".join(hashlib.blake2b(m[k * ROWS : (k + 1) * ROWS].tobytes(), digest_size=8).digest() for k in range(BANDS)), "<i8") for m in minima]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
                arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([m.astype(np.uint8).tobytes() for m in minima], pa.binary()), bands]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["rid", "doc_id", "text", "n_shingles", "digest", "minima", "bands"])

    return docs.mapInArrow(run, "rid long, doc_id long, text string, n_shingles long, digest binary, minima binary, bands array<long>")


def _alike(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, minima_a, minima_b) whose minima agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                agree = (left == right).mean(1) >= LEAST_ESTIMATE
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(agree))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of rids whose whole sets have 100 * intersection >= percent * union.

    A centre's text goes once to each task with GROUP of its members, not once a pair.
    """
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    part = F.pmod(F.xxhash64("a"), "groups").cast("int").alias("part")
    kinds = (F.struct(F.col(rid).alias("rid"), "b", part, F.lit(role).alias("role")) for role, rid in enumerate("ba"))
    roles = staged(pairs.join(counts, "b").select(F.inline(F.array(*kinds))).distinct(), "roles")
    place = F.pmod(F.xxhash64("rid"), F.lit(BUCKETS)).cast("int")
    few = roles.select(place.alias("place")).distinct()
    wanted = texts.select("rid", "text", place.alias("place")).join(F.broadcast(few), "place", "left_semi")
    rows = wanted.hint("merge").join(roles, "rid").select("b", "part", "role", "rid", "text")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for whole in batches:
            for batch in slices(whole, 4, 1_000_000):
                sets = Words(texts_of(batch, 4)).shingles(size)
                found: list[tuple[int, int]] = []
                for b, role, rid, one in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), sets, strict=True):
                    if role == 0:
                        centre, own = b, one
                    elif b == centre:
                        both = len(own) + len(one) - len(np.union1d(own, one))
                        if 100 * both >= percent * (len(own) + len(one) - both):
                            found.append((rid, b))
                columns = list(zip(*found, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component): each node with the smallest node it is connected with.

    Alternating large-star and small-star. A star's minimum comes from an aggregate with map-side combining
    and is joined back, so that no node's neighbours meet in one task. Each star is written by a query of
    its own, which also counts: the driver keeps the plans of many queries, and every new plan of their stages.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        ends = [F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))]
        both = pairs.select(F.inline(F.array(*ends[: 1 + large])))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        links = F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in ("u", "v"))))
        return joined.select(links).where("a <> b").distinct()

    def written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        table = staged(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("hashes")), "edges")
        return table, (seen.get["n"], seen.get["hashes"])

    pairs, before = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        last, wide = pairs, staged(star(pairs, True), "edges")
        pairs, now = written(star(wide, False))
        discard(last, wide)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    """Bucket members with their component; a node without links is its own."""
    joined = members.join(components.withColumnRenamed("node", "rid"), "rid", "left")
    return joined.select("bucket", "band", "rid", "size", F.coalesce("component", "rid").alias("component"))


def _still_open(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return members.join(mixed.select("bucket"), "bucket")


def _across(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that share a bucket and whose minima agree often enough.

    A bucket is compared in blocks, and what doesn't agree never leaves the task. A pair comes from the
    first band that it shares only.
    """
    parts = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = members.join(parts, "bucket").join(classes.select("rid", "minima", "bands"), "rid")
    part = F.pmod(F.xxhash64("rid"), "parts").cast("int")
    rows = rows.select("bucket", "band", "rid", "component", "size", "minima", "bands", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    key = F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")

    def run(table: pa.Table) -> pa.Table:
        rid, component, size, part = (table[c].to_numpy() for c in ("rid", "component", "size", "part"))
        minima = np.frombuffer(b"".join(table["minima"].to_pylist()), np.uint8).reshape(len(rid), -1)
        bands = np.asarray(table["bands"].combine_chunks().flatten(), np.int64).reshape(len(rid), -1)
        band, low, high = table["band"][0].as_py(), table["low"][0].as_py(), table["high"][0].as_py()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(left), 64):
            i = left[start : start + 64]
            small, large = np.minimum(size[i][:, None], size[right]), np.maximum(size[i][:, None], size[right])
            x, y = np.nonzero((component[i][:, None] != component[right]) & (100 * small >= percent * large) & ((low != high) | (rid[i][:, None] < rid[right])))
            x, y = i[x], right[y]
            for k in range(0, len(x), 20_000):
                p, q = x[k : k + 20_000], y[k : k + 20_000]
                first = (bands[p] == bands[q]).argmax(1) == band
                p, q = p[first], q[first]
                alike = (minima[p] == minima[q]).mean(1) >= LEAST_ESTIMATE
                found.append((p[alike], q[alike]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in (0, 1))
        return pa.table({"a": pa.array(rid[a], pa.int64()), "b": pa.array(rid[b], pa.int64())})

    return rows.select("*", *key).groupBy("bucket", "low", "high").applyInArrow(run, "a long, b long")


def _links(classes: DataFrame, texts: DataFrame, size: int, percent: int, rounds: int) -> DataFrame:
    """classes (rid, n_shingles, minima, bands) to the components (node, component) that verified links make."""
    buckets = classes.select("rid", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("band", "key"))
    buckets = buckets.select("rid", "size", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = staged(buckets.hint("merge").join(shared, "bucket"), "buckets")
    minima = classes.select("rid", "minima")
    components = None
    for turn in range(rounds + 1):
        if turn:
            last, members = members, staged(_still_open(_labelled(members.drop("component"), components)), "open")
            discard(last)
            if members.isEmpty():
                break
        now = members if turn else members.withColumn("component", F.col("rid"))
        if turn < rounds:
            pick = F.col("rid") if turn == 0 else F.xxhash64("rid", "bucket", F.lit(turn))
            centre = now.groupBy("bucket").agg(F.min(F.struct(pick.alias("order"), "rid", "size", "component")).alias("c"))
            pairs = now.join(centre, "bucket").where("component <> c.component")
            pairs = pairs.where(100 * F.least("size", "c.size") >= percent * F.greatest("size", "c.size"))
            pairs = pairs.select(F.col("rid").alias("a"), F.col("c.rid").alias("b")).distinct()
            left, right = (minima.select(F.col("rid").alias(x), F.col("minima").alias(f"minima_{x}")) for x in ("a", "b"))
            alike = _alike(pairs.join(left, "a").join(right, "b").select("a", "b", "minima_a", "minima_b"))
        else:
            alike = _across(now, classes, percent)
        alike = staged(alike, "alike")
        if turn and alike.isEmpty():
            continue
        new = links = staged(_verified(alike, texts, size, percent), "links")
        if turn and links.isEmpty():
            discard(alike, links)
            continue
        if components is not None:
            new = new.union(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        last, components = components, staged(connected_components(new), "components")
        discard(alike, links, *([last] if last is not None else []))
    return components


def near_duplicates(docs: DataFrame, shingle_words: int = 4, percent: int = 80, rounds: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept; also first (one row of each component) and text_key.

    Sets of distinct runs of shingle_words words (of fewer words, one run); two documents are linked if
    100 * intersection >= percent * union, and a component is what links connect; component_id is its
    smallest doc_id. A text without words (null, empty) is linked with nothing. Nulls among doc_ids count
    as largest; rows may repeat; other columns are ignored; an empty table gives an empty one. A pair of
    exactly the threshold is missed with a probability below 1e-4, one of 0.85 below 1e-7: it has to share
    one of 30 bands of 5 minima (missed by less than 1e-5), and 73.5 % of 600 minima have to agree.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = staged(signatures(rows, shingle_words), "signatures")
    sets = signed.where("digest is not null")
    head = F.min_by(F.struct("rid", "n_shingles", "minima", "bands"), "rid").alias("head")
    classes = staged(sets.groupBy("digest").agg(head).select("digest", "head.*"), "classes")
    of = sets.select("rid", "doc_id", "digest").join(classes.select("digest", F.col("rid").alias("head")), "digest").select("rid", "doc_id", "head")
    components = _links(classes, signed, shingle_words, percent, rounds)
    part = components.select(F.col("node").alias("head"), "component")
    labelled = staged(of.join(part, "head", "left").select("rid", "doc_id", F.coalesce("component", "head").alias("component")), "labelled")
    order: Column = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    leads = labelled.groupBy("component").agg(F.min(order).alias("lead"))
    final = labelled.join(leads, "component").select("rid", F.col("lead.doc_id").alias("lead_id"), F.col("lead.rid").alias("lead_rid"))
    base = signed.select("rid", "doc_id", "n_shingles", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    out = base.join(final, "rid", "left")
    lead_id = F.when(F.col("lead_rid").isNull(), F.col("doc_id")).otherwise(F.col("lead_id"))
    return out.select(
        "doc_id", "n_shingles", lead_id.alias("component_id"), F.col("doc_id").eqNullSafe(lead_id).alias("kept"),
        (F.coalesce("lead_rid", "rid") == F.col("rid")).alias("first"), "text_key",
    )


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns as they are, with one document of each component; rows without words stay, however often they repeat."""
    key, own, n = (unused(name, docs.columns) for name in ("key", "own", "n"))
    first = near_duplicates(docs, shingle_words, percent).where("first").select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({key: F.xxhash64(text), own: F.col("doc_id").cast("long")})
    kept = rows.join(first, rows[own].eqNullSafe(first["first_id"]) & (rows[key] == first["first_key"]), "left_semi")
    once = F.row_number().over(Window.partitionBy(own, key).orderBy(F.lit(1)))
    wordless = ~F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))
    return kept.withColumn(n, once).where((F.col(n) == 1) | wordless).select(*docs.columns)
