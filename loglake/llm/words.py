"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than space and \\x09-\\x0D. Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_CODES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for seed in (7, 8)]
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass
class Words:
    """``buf`` holds the words, one separator byte after each; word i is buf[start[i]:end[i]], of text doc[i]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def split_words(texts: list[bytes | None]) -> Words:
    data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    doc_end = np.cumsum([len(t or b"") + 1 for t in texts])
    space = _SPACE[data]
    keep = ~space
    keep[1:] |= keep[:-1] & space[1:]
    buf, space = data[keep], space[keep]
    # Every word is now followed by exactly one separator.
    end = np.flatnonzero(space)
    start = np.empty_like(end)
    if len(end):
        start[0], start[1:] = 0, end[:-1] + 1
    doc = np.searchsorted(doc_end, np.flatnonzero(keep)[end], side="right") if len(end) else end
    return Words(np.where(space, np.uint8(32), buf), start, end, doc.astype(np.int32), len(texts))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, kept for the next call."""
    if len(_powers[0]) < n:
        size = (n | ((1 << 18) - 1)) + 1
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over the whole number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """Hashes of all words; those of the two seeds are independent."""
    power, inverse = _power_tables(len(w.buf) + 1)
    prefix = np.zeros(len(w.buf) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[seed][w.buf] * power[: len(w.buf)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[w.end] - prefix[w.start]) * inverse[w.start])


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words of one text."""
    n = len(w.start) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(w)
    acc = np.zeros(n, np.uint64)
    for i in range(size):
        acc = acc * _STEP + h[i : i + n]
    first = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    return first, mix(acc[first])


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word count and hash of every shingle: each run of ``size`` words, or a shorter text as a whole."""
    first, hashes = window_hashes(w, size)
    counts = w.per_doc()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return first, np.full(len(first), size), hashes
    h, begin = word_hashes(w), np.cumsum(counts)[short] - counts[short]
    acc = counts[short].astype(np.uint64)
    for i in range(size - 1):
        more = counts[short] > i
        acc[more] = acc[more] * _STEP + h[begin[more] + i]
    return (
        np.concatenate((first, begin)),
        np.concatenate((np.full(len(first), size), counts[short])),
        np.concatenate((hashes, mix(acc))),
    )


def shingle_sets(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ordered by text and hash, and where each text's part begins."""
    first, _, hashes = shingles(w, size)
    doc = w.doc[first]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(w.n_docs + 1))


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, texts as bytes) of consecutive rows of about ``limit`` bytes; a longer text comes alone."""
    start = 0
    sizes = pc.fill_null(pc.binary_length(batch[column].cast(pa.binary())), 0).to_pylist()
    total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, batch[column].slice(start, i - start).cast(pa.binary()).to_pylist()
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, batch[column].slice(start).cast(pa.binary()).to_pylist()
