"""Quality classifier from overlapping heuristic labellers.

Labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote
patterns in the whole corpus estimates how often each labeller that votes is right; the posterior of a
document's pattern is its soft label. A bounded sample of soft-labelled documents trains a linear scorer
on hashed words and word shapes, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_text import STOP_WORDS
from .words import PLACES, Words, mixed, slices, texts_of

LABELLERS = ("symbols", "capitals", "repeats", "separators", "stop_words", "sentences", "variety", "word_length")
#: Features are hashed to this many places.
PLACES_BITS = 15
#: Vote patterns: three votes of eight labellers, the bound of what is gathered of the corpus.
PATTERNS = 3 ** len(LABELLERS)
#: Words that a text's count is raised by, so that a few words say little.
EXTRA = 8


def _stop_numbers() -> np.ndarray:
    words = sorted({w for text in STOP_WORDS.values() for w in text.split()})
    return np.unique(Words([w.encode() for w in words]).number)


def _classes() -> np.ndarray:
    """Class of each byte in a word's shape: lower case and non-ASCII, upper case, digits, each other byte for itself."""
    out = np.arange(256)
    out[[*range(97, 123), *range(128, 256)]], out[65:91], out[48:58] = 97, 65, 48
    return out.astype(np.uint64)


CLASS = _classes()
SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#$%&*!@^~|=+<>_\\{}", np.uint8)] = True


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text's words."""
    upto = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return upto[first[1:]] - upto[first[:-1]]


class Measured:
    """Words of a batch with what the labellers and the scorer look at."""

    def __init__(self, texts: list[bytes], stop: np.ndarray):
        words = Words(texts, lower=False)
        data = words.data
        low = Words(texts).number
        self.first, self.n = words.first, np.diff(words.first)
        a, z = words.start, words.end - 1
        b, y = np.minimum(a + 1, z), np.maximum(z - 1, a)
        size = words.end - a
        self.repeats = np.zeros(len(a), bool)
        if len(a):
            self.repeats[1:] = (low[1:] == low[:-1]) & ~np.isin(np.arange(1, len(a)), self.first)
            head, second, last, before = (CLASS[data[i]] for i in (a, b, z, y))
        else:
            head = second = last = before = np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            shape = mixed(head * PLACES[0] + second * PLACES[1] + last * PLACES[2] + before * PLACES[3])
        mask = np.uint64((1 << PLACES_BITS) - 1)
        self.places = np.concatenate((low & mask, shape & mask, np.where(self.repeats, np.uint64(1), np.uint64(0))[: len(a)])).astype(np.int64)
        share = lambda v: _sums(v, self.first) / np.maximum(self.n, 1)
        self.symbols = share(SYMBOL[data[z]] & (SYMBOL[data[y]] | (size == 1))) if len(a) else np.zeros(len(texts))
        self.capitals = share((head == 65) & (second == 65) & (size > 1))
        self.repeated = share(self.repeats)
        self.bars = share((size == 1) & (last == 124))
        self.stops = share(np.isin(low, stop) & ~self.repeats)
        self.marks = share(((last == 46) | (last == 44)) & ~self.repeats)
        self.letters = share(size)
        spans = zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)
        self.variety = np.array([len(np.unique(low[i:j])) / max(j - i, 1) ** 0.8 for i, j in spans])  # distinct words grow slower than words

    def votes(self) -> np.ndarray:
        """One row a text: 1 good, -1 bad, 0 nothing, in the order of LABELLERS."""
        both = lambda good, bad: np.where(bad, -1, np.where(good, 1, 0))
        fault = lambda bad: both(False, bad)
        n, some = self.n, self.n > 15
        out = np.stack([
            fault(self.symbols > 0.1), fault((self.capitals > 0.25) & some), fault((self.repeated > 0.12) & (n > 5)), fault(self.bars > 0.08),
            both(self.stops > 0.12, (self.stops < 0.04) & some),
            both((self.marks > 0.02) & (self.marks < 0.4) & some, (n > 40) & ((self.marks > 0.7) | (self.marks < 0.005))),
            fault((self.variety < 0.3) & (n > 30)), fault(((self.letters < 1.8) | (self.letters > 16)) & some),
        ], axis=1)
        out[n == 0] = 0
        return out


def pattern_number(votes: np.ndarray) -> np.ndarray:
    return (votes + 1) @ (3 ** np.arange(len(LABELLERS)))


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    """How many documents have each pattern of votes: at most PATTERNS rows."""
    stop = _stop_numbers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PATTERNS, np.int64)
        for whole in batches:
            for batch in slices(whole, 0, 1_000_000):
                counts += np.bincount(pattern_number(Measured(texts_of(batch, 0), stop).votes()), minlength=PATTERNS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], ["pattern", "n"])

    rows = docs.select("text").mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return {r["pattern"]: r["n"] for r in rows}


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of `good` for every pattern, each labeller's accuracy where it votes, P(good).

    A labeller that doesn't vote says nothing. Accuracies start at 0.8 and stay within 0.55 and 0.99.
    """
    votes = np.arange(PATTERNS)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    n = np.zeros(PATTERNS)
    n[list(counts)] = list(counts.values())
    accuracy, prior = np.full(len(LABELLERS), 0.8), 0.7
    for _ in range(rounds):
        good = 1 / (1 + np.exp(-(votes @ np.log(accuracy / (1 - accuracy)) + np.log(prior / (1 - prior)))))
        right = (n * good) @ (votes == 1) + (n * (1 - good)) @ (votes == -1)
        accuracy = ((right + 0.8) / (n @ (votes != 0) + 1)).clip(0.55, 0.99)
        prior = float(((n @ good + 1) / (n.sum() + 2)).clip(0.05, 0.95))
    return good, accuracy, prior


def _train(rows: pa.Table, rounds: int = 200, rate: float = 0.3, shrink: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer on soft labels; the last is the bias."""
    size = 1 << PLACES_BITS
    weights = np.zeros(size + 1)
    if not len(rows):
        return weights
    label, places, shares = (rows[c].combine_chunks() for c in ("label", "places", "shares"))
    label, of = label.to_numpy(), np.repeat(np.arange(len(rows)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
    at, value = places.flatten().to_numpy(), shares.flatten().to_numpy().astype(np.float64)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(of, weights[at] * value, len(rows)) + weights[-1]).clip(-30, 30)))
        error = (p - label) / len(rows)
        slope = np.append(np.bincount(at, error[of] * value, size), error.sum()) + shrink * weights
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        weights -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return weights


def fit(docs: DataFrame, sample: int = 4000) -> np.ndarray:
    """Weights of the scorer. About `sample` documents train it (by hash of doc_id and text, never over twice as many); all documents count in the labels."""
    counts = pattern_counts(docs)
    posterior = estimate(counts)[0]
    stop, one_in = _stop_numbers(), max(1, sum(counts.values()) // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, 1_000_000):
                seen = Measured(texts_of(batch, 0), stop)
                places, shares = [], []
                for p, n in _bags(seen):
                    places.append(p)
                    shares.append(n)
                label = posterior[pattern_number(seen.votes())]
                kinds = pa.list_(pa.int32()), pa.list_(pa.float32())
                yield pa.RecordBatch.from_arrays([pa.array(places, kinds[0]), pa.array(shares, kinds[1]), batch.column(1), pa.array(label)], ["places", "shares", "key", "label"])

    chosen = docs.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0) & F.col("text").isNotNull())
    rows = chosen.select("text", F.xxhash64("doc_id", "text").alias("key")).limit(2 * sample).mapInArrow(run, "places array<int>, shares array<float>, key long, label double").toArrow()
    return _train(rows.sort_by("key"))


def _bags(seen: Measured) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and shares of each text's features."""
    third = len(seen.places) // 3
    for a, b in zip(seen.first[:-1].tolist(), seen.first[1:].tolist(), strict=True):
        own = np.concatenate([seen.places[k * third + a : k * third + b] for k in range(3)])
        places, n = np.unique(own, return_counts=True)
        yield places.astype(np.int32), (n / (b - a + EXTRA)).astype(np.float32)


def _probability(texts: list[bytes], weights: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and probability of each text."""
    seen = Measured(texts, stop)
    third = len(seen.places) // 3
    each = sum(weights[seen.places[k * third : (k + 1) * third]].astype(np.float64) for k in range(3))
    x = _sums(each, seen.first) / (seen.n + EXTRA) + weights[-1]
    return seen.n, np.where(seen.n > 0, 1 / (1 + np.exp(-x.clip(-30, 30))), 0.0).round(6)


def score_documents(docs: DataFrame, sample: int = 4000, least: float = 0.5) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, probability (of good quality), kept.

    Kept are documents of at least `least`. A text without words (null, empty) has probability 0 and goes.
    Repeated rows are scored each; other columns are ignored; an empty table gives an empty one.
    """
    weights, stop = fit(docs, sample).astype(np.float32), _stop_numbers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1_000_000):
                n, p = _probability(texts_of(batch, 1), weights, stop)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(p), pa.array(p >= least)], ["doc_id", "n_words", "probability", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, probability double, kept boolean")


def keep_good(docs: DataFrame, sample: int = 4000, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score_documents keeps."""
    weights, stop, at = fit(docs, sample).astype(np.float32), _stop_numbers(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, 1_000_000):
                yield batch.filter(pa.array(_probability(texts_of(batch, at), weights, stop)[1] >= least))

    return docs.mapInArrow(run, docs.schema)
