"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from shelfloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def fingerprint(text: str | None, size: int = 3) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    runs = [words[k : k + size] for k in range(len(words) - size + 1)] if len(words) >= size else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), seed=42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int]) -> dict[int, int]:
    """Each different fingerprint with the smallest that chains of at most two bits reach."""
    different = sorted(set(prints))
    parent = {p: p for p in different}

    def find(p: int) -> int:
        while parent[p] != p:
            p = parent[p]
        return p

    for k, p in enumerate(different):
        for q in different[:k]:
            if (p ^ q).bit_count() <= 2:
                a, b = find(p), find(q)
                parent[max(a, b)] = min(a, b)
    return {p: find(p) for p in different}


def expected(rows: list[tuple[int | None, str | None]]) -> Counter:
    prints = [fingerprint(text) for _, text in rows]
    of = components(prints)
    ids = defaultdict(list)
    for (doc_id, _), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            ids[of[p]].append(doc_id)
    return Counter((doc_id, f"{p:016x}", min(ids[of[p]], default=None)) for (doc_id, _), p in zip(rows, prints, strict=True))


def test_golay_keys_meet_within_two_bits():
    """Every 23-bit word is within three bits of its codeword; words two bits apart share a key, one bit apart the own key of either."""
    index = simhash.codewords()
    assert np.bincount(index).tolist() == [2048] * 4096
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 23, 300).astype(np.uint32)
    keys = simhash.fuzzy_keys(words)
    assert {len(set(k)) for k in keys.tolist()} <= {1, 6}
    for a in range(23):
        one = simhash.fuzzy_keys(words ^ np.uint32(1 << a))
        assert all(x[0] in set(y) and y[0] in set(x) for x, y in zip(keys.tolist(), one.tolist(), strict=True))
        for b in range(a):
            two = simhash.fuzzy_keys(words ^ np.uint32(1 << a | 1 << b))
            assert all(set(x) & set(y) for x, y in zip(keys.tolist(), two.tolist(), strict=True))


@pytest.mark.parametrize("pairs", [0, 20, 1 << 14])
def test_links_connect_what_is_within_two_bits(spark, pairs):
    """Chains, dense balls around a centre, flips at every pair of bits and random words; hot buckets and small ones alike."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, a, 5)}
    for base in list(prints)[:60]:
        walk = base
        for _ in range(4):
            walk ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(walk)
        prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(prints)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), pairs).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in edges)
    parent = {p: p for p in prints}

    def find(p: int) -> int:
        while parent[p] != p:
            p = parent[p]
        return p

    for r in edges:
        a, b = find(r["a"] % (1 << 64)), find(r["b"] % (1 << 64))
        parent[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == components(list(prints))


def test_documents(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 300))) for _ in range(20)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "ONE\ttwo", "é \U0001f600 x", "Éa b c", "x" * 60_000, "w " * 5000 + "end", "tie tie tie tie"]
    for text in base:
        words = text.split(" ")
        for _ in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        texts += [text, text.upper(), text.replace(" ", "\n  ")]
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    rows += [rows[20], (None, base[0]), (None, "nothing like it anywhere"), (5, None)]
    extra = "doc_id long, text string, fp long, key long, lead long, component string, rid long"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "c", 4) for r in rows], extra)
    got = simhash.simhash_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == expected(rows)
    assert simhash.simhash_duplicates(spark.createDataFrame([], extra)).collect() == []
    runs = " ".join(rng.choices(vocabulary, k=100_000))  # more runs than are hashed at once
    assert simhash.fingerprints([runs.encode()])[0] == fingerprint(runs)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op11_simhash(spark, SF).collect())) == expected(rows)
