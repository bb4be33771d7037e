"""Quality scores of documents: histogram gradient-boosted trees over statistics of the text.

Every whole text becomes a row of statistics - lengths, shares of kinds of characters and words, repetition - in one
pass, kept in the shared folder. Trees are fitted by numpy on a bounded sample of labelled rows: values are cut into
bins at the sample's quantiles, and each level of a tree is grown from histograms of gradients over the bins. All trees
have the same depth and lie in flat arrays, a node's children at 2i + 1 and 2i + 2, so that texts are scored by walking
all trees at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import stored
from loglake.llm.words import mix, split_words, text_chunks, window_hashes, word_hashes

HELD_OUT = (3, 1)
# The bound of the fitting sample: rows with text and label, of all training rows.
MAX_ROWS = 20_000
BINS = 64
TREES = 120
DEPTH = 4
RATE = 0.1
PENALTY = 2.0
MIN_WEIGHT = 2.0

STATISTICS = [
    "log_words", "log_chars", "word_length", "word_length_spread", "longest_word", "letters", "upper", "digits", "marks",
    "sentence_marks", "exclamations", "foreign", "space", "lines", "words_per_line", "repeated_lines", "no_letter",
    "ends_in_mark", "capital", "all_upper", "short_words", "distinct_words", "top_word", "word_entropy", "distinct_windows",
    "words_per_sentence",
]
STATS_SCHEMA = "doc_id long, held_out boolean, place long, stats array<float>"
RESULT_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _bytes(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _bytes("abcdefghijklmnopqrstuvwxyz")
_FOREIGN = np.arange(256) >= 0xC2  # first byte of a character beyond ASCII
_LETTER = _UPPER | _LOWER | _FOREIGN
_DIGIT = _bytes("0123456789")
_SENTENCE = _bytes(".,")
_MARK = _bytes("!\"#$%&()*+/:;<=>?@[\\]^_`{|}~")
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _repeated(text: bytes) -> float:
    """Share of the bytes of the lines that stand earlier in the text."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    total = sum(map(len, lines))
    return 1 - sum(map(len, set(lines))) / total if total else 0.0


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``STATISTICS`` for every text; 0 throughout for a null or empty one."""
    w = split_words(texts)
    n_docs, words = len(texts), w.per_doc()
    some = np.maximum(words, 1)
    bounds = np.cumsum(words)
    first = np.minimum(bounds - words, max(len(w.start) - 1, 0))
    low = w.start[first] if len(w.start) else np.zeros(n_docs, np.int64)
    high = np.where(words > 0, w.end[np.maximum(bounds - 1, 0)] if len(w.end) else 0, low)

    def sums(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(per text, per word) number of bytes of a kind."""
        total = np.zeros(len(w.buf) + 1, np.int32)
        np.cumsum(kind[w.buf], out=total[1:], dtype=np.int32)
        return total[high] - total[low], total[w.end] - total[w.start]

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, values, n_docs) / some

    chars, length = sums(_FIRST & ~_bytes(" "))
    letters, word_letters = sums(_LETTER)
    upper, word_upper = sums(_UPPER)
    marks, _ = sums(_MARK)
    seen = np.maximum(chars, 1)
    last, head = w.buf[w.end - 1], w.buf[w.start]
    lines = np.array([t.count(b"\n") + 1 if t else 0 for t in texts])
    sizes = np.array([len(t) if t else 0 for t in texts])
    mean = per_doc(length)
    longest = np.zeros(n_docs)
    np.maximum.at(longest, w.doc, length)

    owner = mix(w.doc.astype(np.uint64) + np.uint64(1))
    _, at, counts = np.unique(word_hashes(w) ^ owner, return_index=True, return_counts=True)
    top, share = np.zeros(n_docs), counts / some[w.doc[at]]
    np.maximum.at(top, w.doc[at], share)
    entropy = np.bincount(w.doc[at], -share * np.log(share), n_docs) / np.log(some + 1)
    place, window = window_hashes(w, 3)
    distinct = np.unique(window ^ owner[place], return_index=True)[1]
    windows = np.bincount(w.doc[place[distinct]], minlength=n_docs) / np.maximum(words - 2, 1)
    sentences = np.bincount(w.doc, _bytes(".!?")[last], n_docs)

    columns = [
        np.log1p(words), np.log1p(chars), mean, np.sqrt(np.maximum(per_doc(length.astype(float) ** 2) - mean**2, 0)),
        np.log1p(longest), letters / seen, upper / np.maximum(letters, 1), sums(_DIGIT)[0] / seen, marks / seen,
        sums(_SENTENCE)[0] / seen, sums(_bytes("!"))[0] / seen, sums(_FOREIGN)[0] / seen,
        np.where(sizes > 0, 1 - (high - low - words + 1) / np.maximum(sizes, 1), 0), lines / some,
        words / np.maximum(lines, 1), np.array([_repeated(t) if t else 0.0 for t in texts]), per_doc(word_letters == 0),
        per_doc(_MARK[last]), per_doc(_UPPER[head]), per_doc((word_upper == word_letters) & (word_letters > 1)),
        per_doc(length <= 3), np.bincount(w.doc[at], minlength=n_docs) / some, top, entropy, windows,
        words / np.maximum(sentences, 1),
    ]
    return np.where(words[:, None] > 0, np.stack(columns, axis=1), 0).astype(np.float32)


@dataclass
class Forest:
    """Trees of one depth. An inner node sends values above its threshold to the right child."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for every row of statistics."""
        trees, inner = self.feature.shape
        node, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def _grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, leaf value) of one tree; a node without a gain sends all rows to its left child."""
    n, d = binned.shape
    feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS)
    column = np.arange(d) * BINS
    node = np.zeros(n, np.int64)
    for depth in range(DEPTH):
        count = 1 << depth
        cell = (node[:, None] * (d * BINS) + column + binned).ravel()
        shape = (count, d, BINS)
        g = np.bincount(cell, np.repeat(gradient, d), count * d * BINS).reshape(shape).cumsum(axis=2)
        h = np.bincount(cell, np.repeat(hessian, d), count * d * BINS).reshape(shape).cumsum(axis=2)
        all_g, all_h = g[:, :, -1:], h[:, :, -1:]
        gain = g**2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
        gain[(h < MIN_WEIGHT) | (all_h - h < MIN_WEIGHT)] = 0
        best = gain.reshape(count, -1).argmax(axis=1)
        useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
        at = count - 1 + np.arange(count)
        feature[at] = np.where(useful, best // BINS, 0)
        cut[at] = np.where(useful, best % BINS, BINS)
        right = binned[np.arange(n), feature[at][node]] > cut[at][node]
        node = 2 * node + right
    g, h = np.bincount(node, gradient, 1 << DEPTH), np.bincount(node, hessian, 1 << DEPTH)
    return feature, cut, -RATE * g / (h + PENALTY)


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the log-loss of labels 0 and 1; without rows all scores are a half."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    levels = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(c, levels, method="lower")) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if len(x) else x
    features, thresholds, leaves, margin = [], [], [], np.full(len(y), base)
    for _ in range(TREES if len(set(y.tolist())) == 2 else 0):
        p = 1 / (1 + np.exp(-margin))
        feature, cut, leaf = _grow(binned, p - y, p * (1 - p))
        features.append(feature)
        thresholds.append([edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature, cut)])
        leaves.append(leaf)
        margin = Forest(base, np.array(features[-1:]), np.array(thresholds[-1:]), np.array([leaf])).margins(x) - base + margin
    inner = (1 << DEPTH) - 1
    return Forest(
        base, np.array(features, np.int64).reshape(-1, inner), np.array(thresholds, np.float64).reshape(-1, inner),
        np.array(leaves, np.float64).reshape(-1, inner + 1),
    )


def _held_out() -> Column:
    """Rows without an id are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(True))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, place (a hash of row and text), stats of every row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                own = statistics(texts)
                ends = np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c].slice(first, len(texts)) for c in ("doc_id", "held_out", "place")),
                        pa.ListArray.from_arrays(ends, pa.array(own.ravel())),
                    ],
                    ["doc_id", "held_out", "place", "stats"],
                )

    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)).alias("place")
    return stored(docs.select("doc_id", _held_out().alias("held_out"), place, "text").mapInArrow(run, STATS_SCHEMA), "stats")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, len(STATISTICS))


def train(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """A forest for the ``quality`` of ``labels``, from at most ``max_rows`` rows: those with the smallest ``place``.

    Null labels, others than 0 and 1, and rows held out are left out; an id with both labels counts with both. Rows
    that agree in id and text are one. Only about four times the sample is ranked, after a cut that depends on the
    number of labelled rows.
    """
    wanted = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    marked = stats.where("NOT held_out").join(wanted, "doc_id").select("place", "quality", "stats")
    n = marked.agg(F.approx_count_distinct("place")).first()[0]
    near = marked.where(F.col("place") < min(1.0, 4 * max_rows / max(n, 1)) * float(1 << 62))
    sample = near.dropDuplicates(["place", "quality"]).orderBy("place", "quality").limit(max_rows).toArrow()
    return fit(_matrix(sample["stats"]), sample["quality"].to_numpy())


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``document_statistics``."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(_matrix(batch["stats"]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return stats.select("doc_id", "held_out", "stats").mapInArrow(run, RESULT_SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; others ignored).

    ``labels`` has doc_id and quality. Null and empty texts have statistics of 0 and are scored like any other. Rows
    with a null doc_id count as held out. Equal texts have equal scores. If no label can be learned from, every score
    is 0.5.
    """
    stats = document_statistics(docs)
    return score(stats, train(stats, labels))
