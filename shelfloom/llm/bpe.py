"""Byte-level BPE over Arrow batches with the tokenizers library.

A rank file gives the vocabulary; its merges follow from the ranks. Texts are cut by the pattern, each
piece goes through the byte-to-character table into the BPE model, and decoding reverses that table.
Pieces are remembered per task, in a table of bounded size, so a frequent word is merged once.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a task's table of pieces, and of its table of words.
REMEMBERED = 400_000
#: White space as the rank file's own pattern engine has it (Unicode White_Space).
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_PAIRS = [" " + w for w in WHITE]


def own_spaces(pattern: str) -> str:
    """The pattern with WHITE in place of the regex library's idea of white space."""
    return pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


@cache
def byte_characters() -> tuple[str, ...]:
    """The character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return tuple(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


@cache
def character_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder for one rank file; made once per Python worker by ``byte_bpe``."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = read_ranks(path)
        shown = byte_characters()
        self.text_of = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            halves = ((token[:i], token[i:]) for i in range(1, len(token)))
            pairs = sorted((ranks[a], ranks[b], a, b) for a, b in halves if a in ranks and b in ranks)
            merges += [(self.text_of[a], self.text_of[b]) for _, _, a, b in pairs]
        vocab = {self.text_of[token]: rank for token, rank in ranks.items()}
        self.model = Tokenizer(BPE(vocab, merges, ignore_merges=True))
        self.cut = regex.compile(own_spaces(pattern)).findall
        back = character_bytes()
        self.bytes_of = {rank: bytes(back[c] for c in name) for name, rank in vocab.items()}
        size = np.zeros(max(self.bytes_of) + 1, np.int64)
        size[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        self.size, self.start = size, np.cumsum(size) - size
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(size))), np.uint8)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Merge the pieces not met yet."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        shown = byte_characters()
        mapped = ["".join([shown[b] for b in p.encode()]) for p in new]
        for piece, found in zip(new, self.model.encode_batch(mapped, add_special_tokens=False), strict=True):
            self.known[piece] = np.asarray(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A match of the pattern never runs over a space that a visible character follows, so texts whose
        spaces are all of that kind go through a table of words; the others are cut as a whole.
        """
        cut, words = self.cut, self.words
        if len(words) > REMEMBERED:
            words.clear()
        parts = [None if any(x in t for x in SPACE_PAIRS) or t.endswith(" ") else t.split(" ") for t in texts]
        heads = [cut(t) if p is None else cut(p[0]) for t, p in zip(texts, parts, strict=True)]
        fresh = {w: cut(" " + w) for w in set().union(*(p[1:] for p in parts if p)) if w not in words}
        self.learn(set().union(*heads, *fresh.values()))
        known = self.known
        found = {w: b"".join([known[x] for x in p]) for w, p in fresh.items()}
        words.update((w, x) for w, x in found.items() if len(w) <= 64)
        out = []
        for head, p in zip(heads, parts, strict=True):
            ids = [known[x] for x in head]
            try:
                ids += [words[w] for w in p[1:]] if p else []
            except KeyError:
                ids += [found[w] if w in found else words[w] for w in p[1:]]
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The ids' bytes, gathered a million ids at a time."""
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), 1_000_000):
            some = every[k : k + 1_000_000]
            size = self.size[some]
            ends = np.cumsum(size)
            at = np.repeat(self.start[some] - ends + size, size) + np.arange(ends[-1])
            out.append(self.letters[at].tobytes())
        return b"".join(out)

    def decode_text(self, ids: bytes) -> list[str]:
        """Text of each id: a character whose bytes several ids share comes with the last of them."""
        step, table = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        return [step.decode(table[i]) for i in np.frombuffer(ids, "<u4").tolist()]

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Code points where each id's text starts and ends; ids that split a character all cover it."""
        tokens = [self.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()]
        data = np.frombuffer(b"".join(tokens), np.uint8)
        before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters begun before each byte
        ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
        starts = ends - np.array([len(t) for t in tokens], np.int64)
        inside = np.zeros(len(starts), np.int64)
        inside[:] = (data[starts] & 0xC0) == 0x80 if len(starts) else 0
        return before[starts] - inside, before[ends]


@cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about most bytes of text."""
    sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(batch.column(1)).to_pylist()])
    start = 0
    while start < batch.num_rows:
        upto = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right"))
        upto = max(upto, start + 1)
        yield batch.slice(start, upto - start)
        start = upto


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; also ids and offsets if asked for.

    path is a rank file that every executor has. A null text counts as empty and gives no tokens. Rows
    that repeat are encoded each. Texts are cut and merged whole; memory follows the longest text.
    """
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        kinds += ", ids array<int>, starts array<int>, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for whole in batches:
            for batch in _slices(whole, 4_000_000):
                ids = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
                columns = [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    spans = [bpe.offsets(x) for x in ids]
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    columns += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                    names += ["ids", "starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names)
        bpe.known.clear()  # a worker that goes on to other tasks keeps no tables
        bpe.words.clear()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kinds)
