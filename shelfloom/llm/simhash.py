"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A fingerprint is cut into three segments of at most 23 bits. The Golay code is perfect: every 23-bit word
has one codeword within three bits. Its own index and those of its 23 neighbours, at most six different ones,
are a segment's fuzzy keys, and two segments that differ in one bit share the index of either.

Two fingerprints that differ in two bits or fewer have a segment without a difference whose next one (in a
circle) has at most one: differences (0, 0, 2) and (0, 1, 1) in any order leave no other case. So a key is a
segment as it is with a fuzzy key of the next one. Each fingerprint asks with three keys and is found by
about sixteen, and pairs that meet are verified. Where more than a bounded number of pairs would meet in one
bucket, its fingerprints go another exact way: they meet in words one bit away, where all of them are within
two bits of one another, so that a link to the smallest of each word connects them without any pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import connected_components
from .storage import discard, staged
from .words import Words, slices, texts_of

#: The generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, and the code's length.
GENERATOR, LENGTH = 0b101011100011, 23
SEED = 42
#: Shift and width of a fingerprint's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Where the counts of a byte's values start; the bits of each value, lowest first.
BYTES, BITS = np.arange(8) * 256, np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Shingles that are hashed at once; pairs of one bucket that are compared.
SHINGLES, PAIRS = 1 << 15, 1 << 14


@cache
def codewords() -> np.ndarray:
    """For each word of 23 bits the index (12 bits) of the one codeword within three bits."""
    remainder = np.arange(1 << LENGTH, dtype=np.uint32)
    for k in range(LENGTH - 1, 10, -1):
        remainder ^= ((remainder >> np.uint32(k)) & np.uint32(1)) * np.uint32(GENERATOR << (k - 11))
    errors = np.zeros(1 << 11, np.uint32)  # by remainder: the one pattern of at most three bits that has it
    bits = np.uint32(1) << np.arange(LENGTH, dtype=np.uint32)
    singles = np.concatenate((np.zeros(1, np.uint32), bits))
    patterns = np.unique(singles[:, None, None] ^ singles[None, :, None] ^ singles[None, None, :])
    errors[remainder[patterns]] = patterns
    return ((np.arange(1 << LENGTH, dtype=np.uint32) ^ errors[remainder]) >> np.uint32(11)).astype(np.uint16)


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """The codeword indices of words and of their 23 neighbours: a row for each word, its own first, repeats included."""
    flips = np.concatenate((np.zeros(1, np.uint32), np.uint32(1) << np.arange(LENGTH, dtype=np.uint32)))
    return codewords()[words.astype(np.uint32)[:, None] ^ flips]


def fingerprints(texts: list[bytes], size: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if it is in over half of the hashes of its runs of `size` words, repeats included."""
    words = Words(texts)
    data, starts, ends = words.data.tobytes(), words.start.tolist(), words.end.tolist()
    joined = b" ".join(data[a:b] for a, b in zip(starts, ends, strict=True))
    sizes = np.array(ends, np.int64) - np.array(starts, np.int64)
    upto = np.cumsum(sizes + 1) - 1  # ends of the words in the joined text
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for number, (a, z) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if z == a:
            continue
        first = (upto[a:z] - sizes[a:z]).tolist()
        last = upto[a:z].tolist()
        runs = max(1, z - a - size + 1)
        ones = np.zeros(64, np.int64)
        for k in range(0, runs, SHINGLES):
            upper = min(k + SHINGLES, runs)
            spans = zip(first[k:upper], last[k + size - 1 : upper + size - 1] if z - a >= size else last[-1:], strict=True)
            hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in spans), np.uint64, upper - k)
            counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + BYTES).ravel(), minlength=2048)  # of each value at each of the 8 bytes
            ones += (counts.reshape(8, 256) @ BITS).ravel()
        out[number] = weights[2 * ones > runs].sum(dtype=np.uint64)
    return out


def _hashed(docs: DataFrame, size: int) -> DataFrame:
    """docs (rid, doc_id, text) to rid, doc_id, fp (the fingerprint's bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 2_000_000):
                bits = fingerprints(texts_of(batch, 2), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bits)], ["rid", "doc_id", "fp"])

    return docs.mapInArrow(run, "rid long, doc_id long, fp long")


def _keyed(prints: DataFrame) -> DataFrame:
    """prints (fp) to fp, key, asks: every key of a fingerprint once; it asks with those of its own codewords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(start, 4096).to_numpy().view(np.uint64)
                parts = [(fp >> np.uint64(shift)) & np.uint64((1 << width) - 1) for shift, width in SEGMENTS]
                for number, part in enumerate(parts):
                    near = fuzzy_keys(parts[(number + 1) % 3]).astype(np.int64)
                    own = near[:, :1]
                    near = np.sort(near, 1)
                    fresh = np.concatenate((np.ones((len(fp), 1), bool), np.diff(near, axis=1) != 0), 1)
                    at = np.nonzero(fresh)[0]
                    key = (np.int64(number) << 34) | (part.astype(np.int64)[at] << 12) | near[fresh]
                    columns = [pa.array(fp[at].view(np.int64)), pa.array(key), pa.array((near == own)[fresh])]
                    yield pa.RecordBatch.from_arrays(columns, ["fp", "key", "asks"])

    return prints.mapInArrow(run, "fp long, key long, asks boolean")


def links(prints: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Different fingerprints (fp) to edges (a, b) that connect just what chains of links within two bits connect."""
    keyed = staged(_keyed(prints), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).where("n > 1 and asking > 0")
    sizes = staged(sizes.withColumn("hot", F.col("n") * F.col("asking") > pairs), "sizes")
    few = keyed.join(sizes.where("not hot").select("key"), "key")
    asks, found = few.where("asks").select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    met = asks.join(found, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    hot = keyed.join(sizes.where("hot").select("key"), "key").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    near = hot.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("word"))
    # a word's smallest fingerprint comes from an aggregate with map-side combining and is joined back
    near = staged(near, "words")
    least = near.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = near.join(least, "word").where("fp <> b").select(F.col("fp").alias("a"), "b")
    out = staged(met.union(through).distinct(), "links")
    discard(keyed, sizes, near)
    return out


def simhash_duplicates(docs: DataFrame, size: int = 3, text: str = "text", doc_id: str = "doc_id", pairs: int = PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints of runs of `size` words, repeats included (of fewer words, one run; a text without words,
    null or empty: zero, linked like any other). Fingerprints within two bits are linked, and component_id
    is the smallest doc_id that links reach. No link is missed. Null doc_ids count as largest; rows may
    repeat; other columns are ignored; an empty table gives an empty one. Texts of any length count in full.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hashed = staged(_hashed(rows, size).select("doc_id", "fp"), "simhash")
    prints = staged(hashed.groupBy("fp").agg(F.min("doc_id").alias("lead")), "prints")
    edges = links(prints.select("fp"), pairs)
    components = connected_components(edges)
    part = prints.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lead", F.coalesce("component", "fp").alias("component"))
    leads = part.groupBy("component").agg(F.min("lead").alias("component_id"))
    of = part.join(leads, "component").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return hashed.join(of, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")
