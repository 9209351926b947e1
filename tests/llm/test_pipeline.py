"""The pipeline against a plain version of each stage on its own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from shelfloom.llm import bpe

SF = "/root/testdata/sf0.001"


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe" or docs.columns == columns
        inputs.append(docs.collect())
    whole, good, exact, near, mixed, tokens = inputs

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert all(d in kept for d, q in labels.items() if q == 1)
    assert sum(d in kept for d, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())

    first: dict[str, int] = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(first.values())

    sets = {r["doc_id"]: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})(words(r["text"])) for r in exact}
    ids, parent = sorted(sets), {d: d for d in sets}

    def find(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    for a in ids:
        for b in ids:
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r["doc_id"] for r in near) == [d for d in ids if find(d) == d]

    size = {r["doc_id"]: len(words(r["text"])) for r in near}
    times = Counter(r["doc_id"] for r in mixed)
    assert max(times.values()) <= 2 and set(times) <= set(size)
    per_source, taken = defaultdict(int), defaultdict(int)
    for r in near:
        per_source[r["source"]] += size[r["doc_id"]]
        taken[r["source"]] += times[r["doc_id"]] * size[r["doc_id"]]
    total = sum(per_source.values())
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(per_source))}
    target, left = {}, 1.5 * total
    while True:
        open_ones = {s: w for s, w in weights.items() if s not in target}
        full = [s for s, w in open_ones.items() if 2 * per_source[s] <= left * w / sum(open_ones.values())]
        if not full:
            target |= {s: left * w / sum(open_ones.values()) for s, w in open_ones.items()}
            break
        target |= {s: 2.0 * per_source[s] for s in full}
        left = 1.5 * total - sum(target.values())
    longest = max(size.values())
    assert all(-1 <= taken[s] - target[s] <= longest for s in target)

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter((r["doc_id"], len(plain.encode_ordinary(r["text"] or ""))) for r in mixed)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens) == want
    assert Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect()) == want
