"""Log-bilinear language model, trained by noise-contrastive estimation, scoring whole texts.

1. Documents are packed into blocks of whole texts in the shared folder. Each block sends its distinct words and how
   often its training documents have them, packed by parts of the key space; the task of a part adds them up and sends
   every block the totals of its words. Nothing is counted on a sample.
2. The model covers all words. A word before a token gives a context vector of its own: the 512 most frequent training
   words have a row each, any other word is the sum of two rows that its hashes choose. The token is predicted in steps:
   its class - a frequent word, the end, or one of 64 or more groups of the other words -, then the leaf of the group, then
   the word by its smoothed share of the leaf's training tokens. Rows and leaves grow with the square root of the corpus,
   the groups and the leaves of one with its fourth root.
3. Every task trains the model on its training documents with noise samples; the parameters are averaged by slices.
4. A text's score adds up the normalised log-probabilities: batched matrix products of the context vectors with all
   classes, and with all leaves of the token's group, give the normalising constants.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import LAST_ID, stored
from loglake.llm.words import Words, split_words, text_chunks, word_hashes

HELD_OUT = (5, 1)
BLOCK_BYTES = 2 << 20
PART_BYTES = 1 << 22
TOP_WORDS = 512
GROUPS = 64
DIMENSIONS = 16
NOISE = 20
LEAF_NOISE = 5
BATCH = 8192
RATE = 0.1
SLICES = 64
PIECE = 32
CELLS = 1 << 15

BLOCK_SCHEMA = "block long, ids binary, null binary, held binary, sizes binary, texts binary, n_bytes long"
WORD_SCHEMA = "part int, block long, n int, words binary"
TOTAL_SCHEMA = (
    "block long, part int, totals binary, n_tokens long, n_words long, top array<struct<hi:long,lo:long,c:long>>, "
    "leaves array<struct<leaf:int,tokens:long,words:long>>"
)
MODEL_SCHEMA = "slice int, weight double, parameters binary"
RESULT_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


@dataclass
class Block:
    number: int
    ids: np.ndarray
    null: np.ndarray
    held: np.ndarray
    words: Words

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the distinct words, 64 and 32 bits, ascending, and the number of each word's key."""
        h = word_hashes(self.words)
        order = np.argsort(h)
        ordered = h[order]
        new = _changes(ordered)
        hi, first, of = ordered[new], order[new], np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        w = self.words
        chosen = Words(w.buf, w.start[first], w.end[first], w.doc[first], w.n_docs)
        return hi, word_hashes(chosen, 1) >> np.uint64(32), of


def _changes(ordered: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for first, texts in text_chunks(batch, "text", BLOCK_BYTES):
            ids, held = (batch[c].slice(first, len(texts)) for c in ("doc_id", "held_out"))
            sizes = [len(t or b"") for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block]),
                    "ids": [ids.fill_null(LAST_ID).to_numpy().astype("<i8").tobytes()],
                    "null": [np.asarray(ids.is_null()).tobytes()],
                    "held": [np.asarray(held).astype(bool).tobytes()],
                    "sizes": [np.array(sizes, "<i8").tobytes()],
                    "texts": [zstandard.compress(b"".join(t.lower() if t else b"" for t in texts), 1)],
                    "n_bytes": pa.array([sum(sizes)]),
                }
            )
            block += 1


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    for r in range(batch.num_rows):
        row = {c: batch[c][r].as_py() for c in ("block", "ids", "null", "held", "sizes", "texts")}
        bounds = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], "<i8")))).tolist()
        data = zstandard.decompress(row["texts"])
        words = split_words([data[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
        yield Block(
            row["block"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["null"], bool),
            np.frombuffer(row["held"], bool), words,
        )


def _part_of(hi: np.ndarray, parts: int) -> np.ndarray:
    """Parts and leaves are ranges of the keys, so a part has few leaves."""
    return _place(hi >> np.uint64(32), parts)


def _place(bits: np.ndarray, n: int) -> np.ndarray:
    """Numbers of 32 bits brought to 0 .. n - 1, in order."""
    return (bits * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _planes(numbers: np.ndarray, kind: str) -> bytes:
    return numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _unplane(planes: np.ndarray, n: int, at: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes[at * n : (at + width) * n].reshape(width, n).T).view(kind).ravel()
    return values.astype(kind[1:])


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch):
                hi, lo, of = b.distinct()
                counts = np.bincount(of[~b.held[b.words.doc]], minlength=len(hi))
                part = _part_of(hi, parts)
                bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                rows = [
                    (
                        int(part[x]), b.number, y - x,
                        zstandard.compress(_planes(hi[x:y], ">u8") + _planes(lo[x:y], ">u4") + _planes(counts[x:y], ">u4"), 1),
                    )
                    for x, y in zip(bounds[:-1], bounds[1:]) if y > x
                ]
                if rows:
                    part, block, n, words = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int32()), pa.array(block), pa.array(n, pa.int32()), pa.array(words)],
                        ["part", "block", "n", "words"],
                    )

    return run


def _totals(rows: list[tuple[int, int, bytes]], part: int, top: int, leaves: int) -> Iterator[dict]:
    """A row for each block with the totals of its words; the first also has the part's sums, leaves and frequent words."""
    planes = [np.frombuffer(zstandard.decompress(data), np.uint8) for _, _, data in rows]
    sizes = [n for _, n, _ in rows]
    hi = np.concatenate([_unplane(p, n, 0, ">u8") for p, n in zip(planes, sizes)])
    lo = np.concatenate([_unplane(p, n, 8, ">u4") for p, n in zip(planes, sizes)])
    counts = np.concatenate([_unplane(p, n, 12, ">u4") for p, n in zip(planes, sizes)]).astype(np.int64)
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new) - 1
    totals = np.bincount(key, counts).astype(np.int64)
    names = order[new]
    best = np.lexsort((lo[names], hi[names], -totals))[:top]
    frequent = [
        {"hi": int(hi[names[k]].view(np.int64)), "lo": int(lo[names[k]]), "c": int(totals[k])} for k in best if totals[k]
    ]
    leaf = _part_of(hi[names], leaves)
    of_leaves = []
    if len(leaf):
        first, n = int(leaf.min()), int(leaf.max() - leaf.min()) + 1
        tokens, known = np.bincount(leaf - first, totals, n), np.bincount(leaf - first, totals > 0, n)
        of_leaves = [{"leaf": first + k, "tokens": int(tokens[k]), "words": int(known[k])} for k in range(n) if known[k]]
    ends = np.cumsum([0, *sizes])
    for i, (block, _, _) in enumerate(rows):
        data = zstandard.compress(_planes(totals[key[ends[i] : ends[i + 1]]], ">i8"), 1)
        own = {"n_tokens": 0, "n_words": 0, "top": [], "leaves": []}
        if not i:
            own = {"n_tokens": int(totals.sum()), "n_words": int((totals > 0).sum()), "top": frequent, "leaves": of_leaves}
        yield {"block": block, "part": part, "totals": data} | own


def _sum_words(top: int, leaves: int):
    """Rows come sorted by part; one part is held at a time."""
    kind = pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("c", pa.int64())])
    leaf = pa.struct([("leaf", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64())])
    schema = pa.schema(
        [("block", pa.int64()), ("part", pa.int32()), ("totals", pa.binary()), ("n_tokens", pa.int64()),
         ("n_words", pa.int64()), ("top", pa.list_(kind)), ("leaves", pa.list_(leaf))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for part, *row in zip(*(batch[c].to_pylist() for c in ("part", "block", "n", "words"))):
                if part != current and held:
                    yield pa.RecordBatch.from_pylist(list(_totals(held, current, top, leaves)), schema)
                    held = []
                current = part
                held.append(tuple(row))
        if held:
            yield pa.RecordBatch.from_pylist(list(_totals(held, current, top, leaves)), schema)

    return run


@dataclass
class Statistics:
    """Of the training documents. Classes: 0 start, 1 end, the frequent words, then the groups of all other words.

    ``leaf_tokens`` and ``leaf_words`` have a row for each group; frequent words are not in them. ``n_rows`` context rows
    are shared by the words that are not frequent.
    """

    n_tokens: int
    n_distinct: int
    n_ends: int
    top_hi: np.ndarray
    top_lo: np.ndarray
    top_counts: np.ndarray
    leaf_tokens: np.ndarray
    leaf_words: np.ndarray
    n_rows: int

    @property
    def first_group(self) -> int:
        return len(self.top_hi) + 2

    @property
    def n_classes(self) -> int:
        return self.first_group + len(self.leaf_tokens)

    def noise(self) -> np.ndarray:
        """Share of each class among the training tokens."""
        counts = np.concatenate(([0, self.n_ends], self.top_counts, self.leaf_tokens.sum(axis=1))) + 0.5
        counts[0] = 0
        return counts / counts.sum()

    def leaf_noise(self) -> np.ndarray:
        """Share of each leaf among the training tokens of its group."""
        counts = self.leaf_tokens + 0.5
        return counts / counts.sum(axis=1, keepdims=True)

    def places(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Class, leaf in the group (-1 for frequent words) and two context rows of every word; the second row of all
        frequent words is the same."""
        groups, size = self.leaf_tokens.shape
        leaf = _part_of(hi, groups * size)
        low = hi & np.uint64(0xFFFFFFFF)
        shared = self.first_group + 1
        out = np.stack(
            [self.first_group + leaf // size, leaf % size, shared + _place(low, self.n_rows), shared + _place(lo, self.n_rows)]
        )
        if len(self.top_hi):
            at = np.minimum(np.searchsorted(self.top_hi, hi), len(self.top_hi) - 1)
            frequent = np.flatnonzero((self.top_hi[at] == hi) & (self.top_lo[at] == lo))
            own = at[frequent] + 2
            out[:, frequent] = own, np.full(len(own), -1), own, np.full(len(own), self.first_group)
        return out

    @property
    def end(self) -> np.ndarray:
        return np.array([1, -1, 1, self.first_group])

    @property
    def start(self) -> np.ndarray:
        return np.array([0, self.first_group])


def _sequence(b: Block, of_word: np.ndarray, of_end) -> tuple[np.ndarray, np.ndarray]:
    """A value for every token, words and then one end for each text, and the texts' numbers."""
    n = b.words.per_doc()
    ends = np.cumsum(n + 1) - 1
    values = np.empty((*of_word.shape[:-1], of_word.shape[-1] + len(n)), of_word.dtype)
    inside = np.ones(values.shape[-1], bool)
    inside[ends] = False
    values[..., inside], values[..., ends] = of_word, of_end
    return values, np.repeat(np.arange(len(n)), n + 1)


def _contexts(rows: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context rows of the tokens one and two before; those of the start before the text."""
    out = []
    for back in (1, 2):
        before = np.repeat(start[:, None], rows.shape[1], axis=1)
        before[:, back:] = np.where(doc[back:] == doc[:-back], rows[:, :-back], start[:, None])
        out.append(before)
    return out[0], out[1]


@dataclass
class Tokens:
    """Of a block: class and leaf of every token, the context rows one and two before it, and its document."""

    classes: np.ndarray
    leaves: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    doc: np.ndarray

    def where(self, chosen) -> Tokens:
        return Tokens(self.classes[chosen], self.leaves[chosen], self.w1[:, chosen], self.w2[:, chosen], self.doc[chosen])


def _tokens(b: Block, stats: Statistics, places: np.ndarray, of: np.ndarray) -> Tokens:
    values, doc = _sequence(b, places[:, of], stats.end[:, None])
    return Tokens(values[0], values[1], *_contexts(values[2:], doc, stats.start), doc)


# Two context tables, one for each position; class targets and biases; leaf targets and biases, by group.
Parameters = list[np.ndarray]


def leaf_shape(n_bytes: int) -> tuple[int, int]:
    """Groups, and leaves of each. A token's class is one of all groups, its leaf one of its group's: beyond GROUPS both
    grow with the fourth root of the corpus, their product with the square root."""
    root = math.isqrt(n_bytes)
    groups = max(GROUPS, math.isqrt(root // 2))
    return groups, -(-root // (2 * groups)) or 1


def _shapes(stats: Statistics) -> list[tuple[int, ...]]:
    contexts = (stats.first_group + 1 + stats.n_rows, DIMENSIONS)
    leaves = stats.leaf_tokens.shape
    return [contexts, contexts, (stats.n_classes, DIMENSIONS), (stats.n_classes,), (*leaves, DIMENSIONS), leaves]


def initial(stats: Statistics) -> Parameters:
    """Small vectors; with biases from the counts, the model starts as that of single words."""
    rng = np.random.default_rng(11)
    p = [rng.normal(0, 0.1, shape).astype(np.float32) for shape in _shapes(stats)]
    p[3] = np.log(np.maximum(stats.noise(), 1e-12)).astype(np.float32)
    p[5] = np.log(stats.leaf_noise()).astype(np.float32)
    return p


def adagrad(p: Parameters) -> Parameters:
    """Sums of squares to start from."""
    return [np.full(x.shape, 1e-8 if k < 2 else 1e-6, np.float32) for k, x in enumerate(p)]


def context(p: Parameters, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    q = p[0].take(w1[0], axis=0)
    for table, rows in ((p[0], w1[1]), (p[1], w2[0]), (p[1], w2[1])):
        q += table.take(rows, axis=0)
    return q


def _sum_rows(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, ascending, and the sum of the gradients of each; only rows that come more than once are added up."""
    # Sorting row and position as one number is several times as fast as argsort.
    order = np.sort(rows.astype(np.int64) << 32 | np.arange(len(rows)))
    ordered = order >> 32
    gradient = gradient.take(order & 0xFFFFFFFF, axis=0)
    first = np.flatnonzero(_changes(ordered))
    n = np.diff(first, append=len(rows))
    out = gradient.take(first, axis=0)
    many = np.flatnonzero(n > 1)
    if len(many):
        chosen = np.flatnonzero(np.repeat(n > 1, n))
        out[many] = np.add.reduceat(gradient.take(chosen, axis=0), np.cumsum(n[many]) - n[many], axis=0)
    return ordered.take(first), out


def _step(x: np.ndarray, sums: np.ndarray, at: np.ndarray, step: np.ndarray) -> None:
    """Adagrad on the rows ``at`` of ``x``, all different."""
    total = sums.take(at, axis=0)
    total += step * step
    sums[at] = total
    np.sqrt(total, out=total)
    np.divide(step, total, out=total)
    total *= RATE
    total += x.take(at, axis=0)
    x[at] = total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -30, 30)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _with_ones(q: np.ndarray) -> np.ndarray:
    """One more column, to which the gradients of biases belong."""
    out = np.ones((len(q), q.shape[1] + 1), np.float32)
    out[:, :-1] = q
    return out


def nce_epoch(p: Parameters, sums: Parameters, stats: Statistics, tokens: Tokens, rng) -> None:
    """One pass of Adagrad over the tokens. Each batch's classes are told from NOISE classes drawn for all of it, the leaf of
    each token from LEAF_NOISE leaves drawn for all of its group."""
    noise, n_leaves = stats.noise(), stats.leaf_tokens.shape[1]
    leaf_noise = stats.leaf_noise().ravel()
    cumulated = np.cumsum(leaf_noise)
    log_noise = (np.log(np.maximum(noise, 1e-12)) + np.log(NOISE)).astype(np.float32)
    log_leaf_noise = (np.log(leaf_noise) + np.log(LEAF_NOISE)).astype(np.float32)
    leaf_targets, leaf_biases = p[4].reshape(-1, DIMENSIONS), p[5].reshape(-1)
    leaf_sums, leaf_bias_sums = sums[4].reshape(-1, DIMENSIONS), sums[5].reshape(-1)

    def step(x: np.ndarray, x_sums: np.ndarray, bias: np.ndarray, bias_sums: np.ndarray, rows, gradient) -> None:
        at, total = _sum_rows(np.concatenate(rows), np.concatenate(gradient))
        total /= np.float32(n)
        _step(x, x_sums, at, total[:, :-1])
        _step(bias, bias_sums, at, total[:, -1])

    for at in range(0, len(tokens.classes), BATCH):
        x = tokens.where(slice(at, at + BATCH))
        t, n = x.classes, len(x.classes)
        drawn = rng.choice(len(noise), NOISE, p=noise)
        q = context(p, x.w1, x.w2)
        offsets = p[3] - log_noise
        vectors, others = p[2].take(t, axis=0), p[2].take(drawn, axis=0)
        up = _sigmoid(-np.einsum("ij,ij->i", q, vectors) - offsets.take(t))
        down = -_sigmoid(q @ others.T + offsets.take(drawn))
        q_step = up[:, None] * vectors + down @ others
        ones = _with_ones(q)
        rest = np.flatnonzero(x.leaves >= 0)
        if len(rest):
            # By group: its tokens lie together, and have the same drawn leaves.
            rest = rest[np.argsort(t[rest].astype(np.int16), kind="stable")]
            group, own = t[rest] - stats.first_group, ones.take(rest, axis=0)
            first = np.flatnonzero(_changes(group))
            present, n_own = group[first], np.diff(first, append=len(rest))
            # Shares of a group's leaves add up to one, so group g has the numbers from g to g + 1.
            other = np.searchsorted(cumulated, present[:, None] + rng.random((len(present), LEAF_NOISE)))
            other = np.clip(other, present[:, None] * n_leaves, present[:, None] * n_leaves + n_leaves - 1)
            leaf = group * n_leaves + x.leaves[rest]
            vectors = leaf_targets.take(leaf, axis=0)
            offset = leaf_biases.take(leaf) - log_leaf_noise.take(leaf)
            up_leaf = _sigmoid(-np.einsum("ij,ij->i", own[:, :-1], vectors) - offset)
            own_step = up_leaf[:, None] * vectors
            # Groups are cut into pieces of equal length, the last filled with zeros, so that one product has them all.
            pieces = -(-n_own // PIECE)
            place = np.repeat((np.cumsum(pieces) - pieces) * PIECE - first, n_own) + np.arange(len(rest))
            padded = np.zeros((pieces.sum() * PIECE, own.shape[1]), np.float32)
            padded[place] = own
            padded = padded.reshape(-1, PIECE, own.shape[1])
            other = other.repeat(pieces, axis=0)
            offset = leaf_biases[other] - log_leaf_noise[other]
            others = np.concatenate((leaf_targets[other], offset[..., None]), axis=2)
            down_leaf = -_sigmoid(padded @ others.transpose(0, 2, 1))
            own_step += (down_leaf @ others[..., :-1]).reshape(-1, DIMENSIONS).take(place, axis=0)
            q_step[rest] += own_step
            steps = (down_leaf.transpose(0, 2, 1) @ padded).reshape(-1, own.shape[1])
            step(leaf_targets, leaf_sums, leaf_biases, leaf_bias_sums, (leaf, other.ravel()), (up_leaf[:, None] * own, steps))
        step(p[2], sums[2], p[3], sums[3], (t, drawn), (up[:, None] * ones, down.T @ ones))
        q_step /= np.float32(n)
        for k, rows in enumerate((x.w1, x.w2)):
            _step(p[k], sums[k], *_sum_rows(rows.ravel(), np.concatenate((q_step, q_step))))


def _dump(p: Parameters) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p]).astype("<f4")


def _load(flat: np.ndarray, stats: Statistics) -> Parameters:
    shapes = _shapes(stats)
    ends = np.cumsum([np.prod(s) for s in shapes])
    return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), shapes)]


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats: Statistics = shared.value
        p, seen = initial(stats), 0
        sums = adagrad(p)
        for batch in batches:
            for b in _blocks(batch):
                hi, lo, of = b.distinct()
                tokens = _tokens(b, stats, stats.places(hi, lo), of)
                tokens = tokens.where(~b.held[tokens.doc])
                nce_epoch(p, sums, stats, tokens, np.random.default_rng(b.number & 0xFFFFFFFF))
                seen += len(tokens.classes)
        if seen:
            for k, values in enumerate(np.array_split(_dump(p), SLICES)):
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([k], pa.int32()), "weight": [float(seen)], "parameters": [values.tobytes()]}
                )

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of every slice; rows come sorted by slice, one is held at a time."""
    current, total, weight = None, None, 0.0

    def mean() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"slice": pa.array([current], pa.int32()), "weight": [weight], "parameters": [(total / weight).astype("<f4").tobytes()]}
        )

    for batch in batches:
        for k, w, data in zip(*(batch[c] for c in ("slice", "weight", "parameters"))):
            own = np.frombuffer(data.as_buffer(), "<f4").astype(np.float64) * w.as_py()
            if k.as_py() != current:
                if current is not None:
                    yield mean()
                current, total, weight = k.as_py(), own, w.as_py()
            else:
                total, weight = total + own, weight + w.as_py()
    if current is not None:
        yield mean()


def _log_sums(q: np.ndarray, targets: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """Log of the normalising constant for every context vector."""
    out = np.empty(len(q), np.float32)
    # No product is larger than the two lengths allow; only where that could overflow is the maximum taken out.
    largest = math.sqrt(np.einsum("ij,ij->i", q, q).max(initial=0) * np.einsum("ij,ij->i", targets, targets).max(initial=0))
    small = largest + np.abs(biases).max(initial=0) < 60
    # exp2 of products that have the factor already takes half the time of exp.
    columns = np.ascontiguousarray(targets.T * np.float32(math.log2(math.e) if small else 1))
    weights = np.exp(biases) if small else None
    rows = max(1, CELLS // len(biases))
    for at in range(0, len(q), rows):
        z = q[at : at + rows] @ columns
        if small:
            np.exp2(z, out=z)
            np.dot(z, weights, out=out[at : at + rows])
        else:
            z += biases
            top = z.max(axis=1)
            out[at : at + rows] = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top
    return np.log(out, out=out) if small else out


def log_probabilities(p: Parameters, stats: Statistics, tokens: Tokens) -> np.ndarray:
    """Natural log of the normalised probability of every token's class and leaf."""
    out = np.empty(len(tokens.classes))
    leaf_targets, leaf_biases = p[4].reshape(-1, DIMENSIONS), p[5].reshape(-1)
    for at in range(0, len(out), BATCH * 8):
        x = tokens.where(slice(at, at + BATCH * 8))
        q = context(p, x.w1, x.w2)
        # The start is never predicted.
        log_p = np.einsum("ij,ij->i", q, p[2].take(x.classes, axis=0)) + p[3].take(x.classes) - _log_sums(q, p[2][1:], p[3][1:])
        rest = np.flatnonzero(x.leaves >= 0)
        rest = rest[np.argsort(x.classes[rest].astype(np.int16), kind="stable")]
        group, own = x.classes[rest] - stats.first_group, q.take(rest, axis=0)
        leaf = group * p[5].shape[1] + x.leaves[rest]
        first = np.flatnonzero(_changes(group))
        of_leaf = np.einsum("ij,ij->i", own, leaf_targets.take(leaf, axis=0)) + leaf_biases.take(leaf)
        for g, begin, end in zip(group[first], first, [*first[1:], len(rest)]):
            of_leaf[begin:end] -= _log_sums(own[begin:end], p[4][g], p[5][g])
        log_p[rest] += of_leaf
        out[at : at + BATCH * 8] = log_p
    return out


def word_shares(stats: Statistics, tokens: Tokens, counts: np.ndarray) -> np.ndarray:
    """Natural log of each word's smoothed share of its leaf; all words never learned share one place in every leaf."""
    out = np.zeros(len(counts))
    rest = np.flatnonzero(tokens.leaves >= 0)
    at = tokens.classes[rest] - stats.first_group, tokens.leaves[rest]
    out[rest] = np.log((counts[rest] + 0.5) / (stats.leaf_tokens[at] + 0.5 * (stats.leaf_words[at] + 1)))
    return out


def _score(shared, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, p = shared.value
        for batch in batches:
            answers = batch["answers"].to_pylist()
            for row, b in enumerate(_blocks(batch)):
                hi, lo, of = b.distinct()
                totals, part = np.zeros(len(hi), np.int64), _part_of(hi, parts)
                for answer in answers[row] or []:
                    x, y = np.searchsorted(part, [answer["part"], answer["part"] + 1])
                    data = np.frombuffer(zstandard.decompress(answer["totals"]), np.uint8)
                    totals[x:y] = _unplane(data, y - x, 0, ">i8")
                tokens = _tokens(b, stats, stats.places(hi, lo), of)
                counts, doc = _sequence(b, totals[of], stats.n_ends)
                log_p = (log_probabilities(p, stats, tokens) + word_shares(stats, tokens, counts)) / np.log(10)
                base = np.log10((counts + 0.5) / (stats.n_tokens + 0.5 * (stats.n_distinct + 1)))
                n = len(b.ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.ids, pa.int64(), mask=b.null), pa.array(b.held),
                        pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[counts > 0], minlength=n)),
                        pa.array(np.full(n, stats.n_tokens)), pa.array(np.bincount(doc, base, n)),
                        pa.array(np.bincount(doc, log_p, n)),
                    ],
                    [f.split()[0] for f in RESULT_SCHEMA.split(", ")],
                )

    return run


def score_texts(docs: DataFrame, top_words: int = TOP_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Rows with crc32(doc_id as text) mod 5 = 1, or a null doc_id, are held out: scored, never learned from. A null or
    empty text is the end alone. Without any training row all counts are 0 and scores those of a model at its start.
    Other columns are ignored; rows with equal doc_id are scored, and learned from, one by one.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(True))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    blocks = stored(rows.mapInArrow(_pack, BLOCK_SCHEMA), "blocks")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_ends = rows.where("NOT held_out").count()
    parts = max(1, n_bytes // part_bytes)
    # Growing with the square root of the corpus, a model per task stays small beside the task's texts.
    (groups, group_leaves), n_rows = leaf_shape(n_bytes), 2 * math.isqrt(n_bytes) + 1
    n_leaves = groups * group_leaves
    words = blocks.mapInArrow(_count_words(parts), WORD_SCHEMA)
    totals = stored(
        words.repartition("part").sortWithinPartitions("part").mapInArrow(_sum_words(top_words, n_leaves), TOTAL_SCHEMA), "totals"
    )
    sums = totals.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    top = (
        totals.where("size(top) > 0").select(F.explode("top").alias("t")).select("t.*")
        .orderBy(F.desc("c"), "hi", "lo").limit(top_words).collect()
    )
    top = sorted((r["hi"] & 0xFFFFFFFFFFFFFFFF, r["lo"], r["c"]) for r in top)
    top_hi = np.array([t[0] for t in top], np.uint64)
    top_counts = np.array([t[2] for t in top], np.int64)
    leaf = F.explode("leaves").alias("l")
    of_leaves = totals.where("size(leaves) > 0").select(leaf).groupBy("l.leaf").agg(F.sum("l.tokens"), F.sum("l.words"))
    sizes = np.zeros((2, n_leaves), np.int64)
    for r in of_leaves.toLocalIterator():  # n_leaves rows at most
        sizes[:, r[0]] = r[1:]
    frequent = _part_of(top_hi, n_leaves)
    sizes[0] -= np.bincount(frequent, top_counts, n_leaves).astype(np.int64)
    sizes[1] -= np.bincount(frequent, minlength=n_leaves)
    stats = Statistics(
        (sums["tokens"] or 0) + n_ends, (sums["words"] or 0) + (n_ends > 0), n_ends,
        top_hi, np.array([t[1] for t in top], np.uint64), top_counts,
        sizes[0].reshape(groups, -1), sizes[1].reshape(groups, -1), n_rows,
    )
    trained = blocks.mapInArrow(_train(spark.sparkContext.broadcast(stats)), MODEL_SCHEMA)
    slices = trained.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_average, MODEL_SCHEMA)
    mean = [np.frombuffer(r["parameters"], "<f4") for r in slices.orderBy("slice").toLocalIterator()]
    p = _load(np.concatenate(mean), stats) if mean else initial(stats)
    shared = spark.sparkContext.broadcast((stats, p))
    answers = totals.groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("answers"))
    return blocks.join(answers, "block", "left").mapInArrow(_score(shared, parts), RESULT_SCHEMA)
