"""Licence scan with a positional index of rare licence words.

The licence templates' words are looked up by document frequency over the whole corpus. Each template is
searched by its rarest words, which vote, with their positions in the file, for the place where it starts;
places on which enough words agree are verified by the template's key phrase and by how many of its words
stand where they should. A template has so many voting words that no place that passes lacks the votes.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: Licence phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: A-Z to a-z, what is no word character to a space, all else as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _find(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand, one after another."""
    out, at, n = [], -1, len(phrase)
    for _ in range(words.count(phrase[-1])):
        at = words.index(phrase[-1], at + 1)
        if at >= n - 1 and words[at - n + 1 : at + 1] == phrase:
            out.append(at - n + 1)
    return out


class Scanner:
    """Templates and phrases with their postings, given the corpus frequencies of licence words."""

    def __init__(self, frequency: dict[bytes, int], documents: int, least_votes: int, least_share: float):
        self.templates = [(label, words_of(key), words_of(notice)) for label, key, notice in TEMPLATES]
        self.phrases = {p: (p.encode().split(), label) for p, label in PHRASES.items()}
        weight = {w: math.log((documents + 1) / n) for w, n in frequency.items() if n}
        #: By template: its voting words, each with its places in the notice, and the votes a place needs.
        self.voters: list[tuple[dict[bytes, list[int]], int]] = []
        for _, _, notice in self.templates:
            rarest = sorted(set(notice), key=lambda w: (-weight.get(w, math.inf), w))
            # a place with least_share misses at most so many words, hence at most so many votes
            missed = len(notice) - math.ceil(least_share * len(notice) - 1e-9)
            chosen = rarest[: missed + least_votes]
            self.voters.append(({w: [k for k, x in enumerate(notice) if x == w] for w in chosen}, max(1, min(least_votes, len(chosen) - missed))))
        self.least_share = least_share

    def share(self, words: list[bytes], template: list[bytes], start: int) -> float:
        return sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(template)) / len(template)

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Places of phrases, their labels, all labels, score."""
        have = set(words)
        places, base, best = [], set(), 0.0
        for phrase, label in self.phrases.values():
            if have.issuperset(phrase) and (found := _find(words, phrase)):
                places += found
                base.add(label)
                for of, _, notice in self.templates:
                    if of == label and (at := _find(notice, phrase)):
                        best = max(best, *(self.share(words, notice, p - at[0]) for p in found))
        labels = set(base)
        at_word: dict[bytes, list[int]] = {}
        for (label, key, notice), (voters, least) in zip(self.templates, self.voters, strict=True):
            if not have.issuperset(key) or (label in labels and best >= 1):
                continue
            votes: dict[int, set[bytes]] = defaultdict(set)
            for w in have & voters.keys():
                if w not in at_word:
                    at_word[w] = [at for at, x in enumerate(words) if x == w]
                for k in voters[w]:
                    for at in at_word[w]:
                        votes[at - k].add(w)
            for start, agreed in votes.items():
                if len(agreed) >= least and (label not in labels or best < 1):
                    share = self.share(words, notice, start)
                    if share >= self.least_share and _find(words[max(start, 0) : start + len(notice)], key):
                        labels.add(label)
                        best = max(best, share)
        return places, base, labels, best


def _frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """Documents that hold each licence word, and all documents: as many rows as the templates have words."""
    vocabulary = {w for _, _, notice in TEMPLATES for w in words_of(notice)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            counts[""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                for w in vocabulary.intersection(words_of(text)):
                    counts[w.decode()] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def scan_licenses(docs: DataFrame, least_votes: int = 3, least_share: float = 0.7) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from PHRASES wherever their words stand side by side; labels adds every template whose
    key phrase and least_share of whose words stand at one place. least_votes is how many of a template's
    rarest words must agree on a place before it is verified; it changes the work, not the result. score is
    the largest such share; 0 without a label. A null or empty text has no words and no labels; an empty
    table gives an empty one; repeated rows are scanned each; other columns are ignored.
    """
    frequency, documents = _frequencies(docs)
    options = (frequency, documents, least_votes, least_share)
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*options)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                places, base, labels, score = scanner.scan(words)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [k.split()[0] for k in kinds.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)
