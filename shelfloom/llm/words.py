"""Words of a batch of texts as 64-bit numbers, by array operations.

Words are runs of anything but space and the control characters 9 to 13, with A-Z in lower case. A word's
number is a polynomial of its bytes modulo 2**64 with random odd coefficients, mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once; only a longer word makes a longer run.
SEGMENT = 1 << 20
_rng = np.random.default_rng(20)
VALUES = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1 << 62, 1 << 63)) * 2 + 1
PLACES = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n."""
    with np.errstate(over="ignore"):
        up, down = (np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64))).cumprod(dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about SEGMENT bytes that end where a word ends."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + SEGMENT, n)
        while end < n:
            gaps = np.flatnonzero(SPACE[data[end : end + 4096]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + 4096, n)
        yield start, end
        start = end


class Words:
    """number, start, end (bytes) of each word of the texts; first: where each text's words begin, and their count at last."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b"\n".join(texts)
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        numbers, starts, ends = [], [], []
        for low, high in _segments(self.data):
            part = self.data[low:high]
            edge = np.diff(np.concatenate(([0], (~SPACE[part]).view(np.int8), [0])))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            up, down = _powers(1 << max(21, (high - low).bit_length()))
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[part] * up[: len(part)], dtype=np.uint64)))
                numbers.append(mixed((sums[b] - sums[a]) * down[a]))
            starts.append(a + low)
            ends.append(b + low)
        none = np.zeros(0, np.int64)
        self.number = np.concatenate([none.astype(np.uint64), *numbers])
        self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.searchsorted(self.start, np.concatenate(([0], np.cumsum(sizes))))

    def shingles(self, size: int) -> list[np.ndarray]:
        """For each text, its distinct runs of `size` words as sorted numbers; of fewer words, one run."""
        n, number = len(self.number), self.number
        with np.errstate(over="ignore"):
            runs = np.zeros(max(n - size + 1, 0), np.uint64)
            for k in range(size if n >= size else 0):
                runs += number[k : n - size + 1 + k] * PLACES[k]
            runs = mixed(runs)
            out = []
            for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
                if b - a >= size:
                    out.append(np.unique(runs[a : b - size + 1]))
                elif b > a:
                    out.append(mixed((number[a:b] * PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
                else:
                    out.append(number[:0])
        return out


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about most bytes of the column's text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        upto = max(int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")), start + 1)
        yield batch.slice(start, upto - start)
        start = upto


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
