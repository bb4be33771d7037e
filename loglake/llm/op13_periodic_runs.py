"""Periodic runs of words: stretches in which a phrase is said over and over, found by Lyndon roots.

A run is a stretch of words with a smallest period q that covers the period at least four times, and cannot be extended.
Every run holds, in one of two opposite word orders, a position whose longest Lyndon word has exactly the run's period.
The first phase of Baier's suffix sorter, which groups positions by their longest Lyndon word, gives those lengths for
both orders without sorting any suffix; each is extended to both sides by longest-common-extension queries over names
of blocks of 2**k words.

Before that, words that cannot lie in a run are left out: all three-word windows of a run occur in it at least three
times, so the stretches covered by such windows are searched, each on its own. No run is lost by it. Work and memory
are linear in a text's words, but for the block names, which have a logarithmic factor in the longest stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loglake.llm.words import Words, mix, split_words, text_chunks, word_hashes

MIN_LENGTH = 6
MIN_PERIODS = 4
WINDOW = 3
REPEATS = 3

DIGEST_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
RUNS_SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every position, for the order of the numbers in ``symbols``.

    Groups of positions are treated from the highest down. A position's ``prev`` is the nearest one to its left in a
    lower group; positions that are the ``prev`` of l members of the group get the group's word appended l times, and
    move to a new group just above their own. A group's word is complete when its turn comes.
    """
    values, ranks = np.unique(symbols, return_inverse=True)
    n, m = len(symbols), len(values)
    group, length = ranks.tolist(), [1] * m
    by_rank = np.argsort(ranks, kind="stable")
    bounds = np.searchsorted(ranks[by_rank], np.arange(m + 1))
    members = [by_rank[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    below, above = list(range(-1, m - 1)), list(range(1, m + 1))
    above[m - 1] = -1
    # Positions whose group is still to come, as a linked list.
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    prev, out = [-1] * n, [0] * n
    top = m - 1
    while top >= 0:
        own, counts = [i for i in members[top] if group[i] == top], {}
        size = length[top]
        for i in own:
            j = left[i]
            if j >= 0 and group[j] == top:
                j = prev[j]
            prev[i] = j
            out[i] = size
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        for i in own:
            a, b = left[i], right[i]
            if a >= 0:
                right[a] = b
            if b < n:
                left[b] = a
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in counts.items():
            moved.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moved, reverse=True):
            new = len(length)
            length.append(length[old] + times * size)
            members.append(moved[times, old])
            for j in moved[times, old]:
                group[j] = new
            upper = above[old]
            below.append(old)
            above.append(upper)
            above[old] = new
            if upper >= 0:
                below[upper] = new
        top = below[top]
    return np.array(out, np.int64)


class Extensions:
    """Longest common extensions in one sequence: level k names every block of 2**k symbols by its content."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.names = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        while 2 << (len(self.names) - 1) <= min(longest, len(symbols)):
            half = 1 << (len(self.names) - 1)
            last = self.names[-1]
            pairs = last[:-half].astype(np.int64) << 32 | last[half:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from ``a`` and ``b`` on; a < b."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                at = np.flatnonzero(b + total < len(names))
                same = at[names[a[at] + total[at]] == names[b[at] + total[at]]]
                total[same] += step
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols up to ``a`` and ``b``, these included; a < b."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                at = np.flatnonzero(a - total - step + 1 >= 0)
                same = at[names[a[at] - total[at] - step + 1] == names[b[at] - total[at] - step + 1]]
                total[same] += step
        return total


def _stretches(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches that may hold a run, by position in ``hashes``; none crosses two texts."""
    piece = doc.astype(np.int64)
    begin, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = np.arange(len(hashes))
    while True:
        n = len(keep) - WINDOW + 1
        if n <= 0:
            return begin[:0], end[:0]
        acc = mix(piece[:n].astype(np.uint64))
        for i in range(WINDOW):
            acc = acc * np.uint64(0xD1342543DE82EF95) + hashes[keep[i : i + n]]
        inside = np.flatnonzero(piece[:n] == piece[WINDOW - 1 :])
        _, kind, counts = np.unique(acc[inside], return_inverse=True, return_counts=True)
        often = inside[counts[kind] >= REPEATS]
        # Words covered by such windows, and where their stretches begin: at a gap, or in another piece.
        covered = np.unique((often[:, None] + np.arange(WINDOW)).ravel())
        if not len(covered):
            return begin[:0], end[:0]
        new = np.ones(len(covered), bool)
        new[1:] = (np.diff(covered) > 1) | (np.diff(piece[covered]) != 0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(covered)))
        long = size >= MIN_LENGTH
        chosen = np.repeat(long, size)
        kept = keep[covered[chosen]]
        begin = keep[covered[first[long]]]
        end = begin + size[long]
        if len(kept) == len(keep):
            return begin, end
        keep, piece = kept, np.repeat(np.arange(long.sum()), size[long])


@dataclass
class Runs:
    """Runs by text, start and period; ``start`` counts from the first word of the text."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(w: Words, source: np.ndarray) -> Runs:
    """All runs of the word sequences of ``w``; the i-th word of all is w's word ``source[i]``."""
    begin, end = _stretches(word_hashes(w)[source], w.doc)
    sizes = end - begin
    # The stretches in one sequence: equal words have equal numbers, and a number of its own stands before each.
    n = int(sizes.sum()) + len(sizes) + 1
    symbols, place = np.empty(n, np.int64), np.zeros(n, np.int64)
    at = np.cumsum(sizes + 1) - sizes
    number: dict[bytes, int] = {}
    data, starts, ends = w.buf.tobytes(), w.start, w.end
    found = []
    symbols[-1] = -1
    for k, (a, b, to) in enumerate(zip(begin.tolist(), end.tolist(), at.tolist())):
        words = source[a:b]
        own = [number.setdefault(data[s:e], len(number)) for s, e in zip(starts[words].tolist(), ends[words].tolist())]
        symbols[to - 1], symbols[to : to + b - a] = -2 - k, own
        place[to : to + b - a] = np.arange(a, b)
        for sign in (1, -1):
            roots = lyndon_lengths(sign * symbols[to : to + b - a])
            ok = np.arange(b - a) + roots < b - a
            found.append(np.stack((np.flatnonzero(ok) + to, roots[ok])))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none)
    root, period = np.unique(np.concatenate(found, axis=1), axis=1)
    # A root that repeats must go on to one side at least.
    goes_on = (symbols[root] == symbols[root + period]) | (symbols[root - 1] == symbols[root + period - 1])
    root, period = root[goes_on], period[goes_on]
    extensions = Extensions(symbols, int(sizes.max()))
    before = extensions.backward(root - 1, root + period - 1)
    length = before + period + extensions.forward(root, root + period)
    enough = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)
    start, period, length = np.unique(np.stack(((root - before)[enough], period[enough], length[enough])), axis=1)
    word = place[start]
    doc = w.doc[word]
    return Runs(doc, word - np.searchsorted(w.doc, doc), length, period)


def plant(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that stands at each of n places, for a tenth of the texts, by id, that turn periodic from some place on;
    None for the others."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g, places = h // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(places < a, places, a + (places - a) % p)


Row = tuple[int | None, list[tuple[int, int, int]], bytes]


def _results(batch: pa.RecordBatch, planted: bool) -> Iterator[list[Row]]:
    """(doc_id, [(start, length, period)], collapsed text in UTF-8) of every row, a few texts at a time."""
    for first, texts in text_chunks(batch, "text"):
        ids = batch["doc_id"].slice(first, len(texts)).to_pylist()
        w = split_words(texts)
        counts = w.per_doc()
        base = (np.cumsum(counts) - counts).tolist()
        source, changed = np.arange(len(w.start)), set()
        if planted:
            for k, (doc_id, n) in enumerate(zip(ids, counts.tolist())):
                places = plant(doc_id, n)
                if places is not None:
                    source[base[k] : base[k] + n] = base[k] + places
                    changed.add(k)
        runs = find_runs(w, source)
        bounds = np.searchsorted(runs.doc, np.arange(len(texts) + 1)).tolist()
        # A word is dropped if it lies beyond the first period of any run.
        change = np.zeros(len(source) + 1, np.int64)
        origin = np.array(base, np.int64)[runs.doc] + runs.start
        np.add.at(change, origin + runs.period, 1)
        np.add.at(change, origin + runs.length, -1)
        kept = np.cumsum(change[:-1]) == 0
        data, rows = w.buf.tobytes(), []
        for k, doc_id in enumerate(ids):
            a, b = base[k], base[k] + int(counts[k])
            own = slice(bounds[k], bounds[k + 1])
            found = list(zip(runs.start[own].tolist(), runs.length[own].tolist(), runs.period[own].tolist()))
            if a == b:
                text = b""
            elif not found and k not in changed:
                text = data[w.start[a] : w.end[b - 1]]
            else:
                words = source[a:b][kept[a:b]]
                text = b" ".join(data[s:e] for s, e in zip(w.start[words].tolist(), w.end[words].tolist()))
            rows.append((doc_id, found, text))
        yield rows


def collapse_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, runs (by start, then period), collapsed of every row of ``docs`` (doc_id, text; others ignored).

    ``collapsed`` has the words of the text, each run cut to its first period, joined by one space. A null or empty
    text, or one of white space, has no runs and an empty result. Rows are looked at one by one: repeated rows give
    equal rows. With ``planted``, texts change first as ``plant`` says; a null doc_id leaves its text as it is.
    """
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _results(batch, planted):
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in found] for _, found, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array(runs, pa.list_(triple)),
                        pa.array([r[2].decode() for r in rows], pa.string()),
                    ],
                    ["doc_id", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, RUNS_SCHEMA)


def _digest(doc_id: int | None, found: list[tuple[int, int, int]], text: bytes) -> tuple:
    start, length, period = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        doc_id, len(found), start, length, period, None if length is None else 1000 * length // period,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
    )


def run_digests(docs: DataFrame) -> DataFrame:
    """The longest run, the number of runs, and digests of all runs and of the collapsed text, of every row of ``docs``
    with its planted periods; nulls and repeated rows as in ``collapse_runs``."""

    names = [field.split()[0] for field in DIGEST_SCHEMA.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _results(batch, planted=True):
                columns = zip(*(_digest(*row) for row in rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)
