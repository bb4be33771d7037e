"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text, hashed to 2**18 numbers; a feature's weight in a text is its
share of the text's n-grams times its inverse document frequency. Document frequencies count every training text;
the regression is fitted on a number of whole texts of every language by follow-the-regularised-leader with
elastic-net penalties, and its temperature on a second, disjoint sample.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import stored
from loglake.llm.words import CHUNK_BYTES, text_chunks

HELD_OUT = (4, 2)
FEATURE_BITS = 18
ORDERS = (1, 2, 3)
PER_LANG = 1000
EPOCHS = 4
BATCH = 16
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCALE = 30.0
UNKNOWN = "und"

FREQUENCY_SCHEMA = "feature int, n long"
VECTOR_SCHEMA = "lang string, place long, part int, features binary, weights binary"
RESULT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def _ngrams(texts: list[bytes | None], orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, feature) of all n-grams, order by order; none crosses two texts."""
    lowered = [t.decode().lower() if t else "" for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le"), "<u4").astype(np.uint64)
    doc = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(t) + 1 for t in lowered])[: len(codes)]
    # The line ends between texts belong to no text.
    ends = np.cumsum([len(t) + 1 for t in lowered])[:-1] - 1
    doc[ends] = -1
    acc = np.zeros(len(codes), np.uint64)
    for order in range(1, max(orders) + 1):
        n = len(codes) - order + 1
        if n <= 0:
            return
        acc = acc[:n] * np.uint64(0x100000001B3) + codes[order - 1 :] + np.uint64(order)
        if order in orders:
            inside = (doc[:n] == doc[order - 1 :]) & (doc[:n] >= 0)
            if order > 2:
                inside &= doc[1 : 1 + n] >= 0
            mixed = acc[inside] * np.uint64(0x9E3779B97F4A7C15)
            yield doc[:n][inside], (mixed >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, texts_seen = np.zeros(1 << FEATURE_BITS, np.int64), 0
    for batch in batches:
        for _, texts in text_chunks(batch, "text", CHUNK_BYTES // 2):
            texts_seen += len(texts)
            for doc, feature in _ngrams(texts, ORDERS):
                pairs = np.unique(doc.astype(np.int64) << FEATURE_BITS | feature)
                counts += np.bincount(pairs & ((1 << FEATURE_BITS) - 1), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(counts[used], texts_seen))], ["feature", "n"]
    )


def _vectors(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of the sample, so no larger than it
        for batch in batches:
            names = list(zip(batch["lang"].to_pylist(), batch["place"].to_pylist()))
            new = []
            for name in names:
                new.append(name not in seen)
                seen.add(name)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for first, texts in text_chunks(batch, "text", CHUNK_BYTES // 2):
                found = list(_ngrams(texts, ORDERS))
                doc = np.concatenate([d for d, _ in found] or [np.zeros(0, np.int32)])
                feature = np.concatenate([f for _, f in found] or [np.zeros(0, np.int32)])
                pairs, counts = np.unique(doc.astype(np.int64) << FEATURE_BITS | feature, return_counts=True)
                owner, feature = pairs >> FEATURE_BITS, (pairs & ((1 << FEATURE_BITS) - 1)).astype("<i4")
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                weight = SCALE * counts / np.maximum(np.bincount(owner, counts, len(texts))[owner], 1) * idf.value[feature]
                own = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c].slice(first, len(texts)) for c in ("lang", "place", "part")),
                        pa.array([feature[x].tobytes() for x in own], pa.binary()),
                        pa.array([weight[x].astype("<f4").tobytes() for x in own], pa.binary()),
                    ],
                    ["lang", "place", "part", "features", "weights"],
                )

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Vector = tuple[np.ndarray, np.ndarray, int]


class Spilled(Sequence):
    """Vectors in a temporary file of the driver, read one at a time; ``chosen`` has their (label, offset, length)."""

    def __init__(self, file, chosen: list[tuple[int, int, int]]):
        self.file, self.chosen = file, chosen

    def __len__(self) -> int:
        return len(self.chosen)

    def __getitem__(self, i) -> Vector:
        label, at, n = self.chosen[i]
        self.file.seek(at)
        data = self.file.read(8 * n)
        return np.frombuffer(data[: 4 * n], "<i4"), np.frombuffer(data[4 * n :], "<f4"), label


def fit_ftrl(vectors: Sequence[Vector], n_classes: int) -> np.ndarray:
    """Weights (features x classes) by FTRL-proximal over small batches, in a fixed random order."""
    z = np.zeros((1 << FEATURE_BITS, n_classes))
    n = np.zeros_like(z)
    rng = np.random.default_rng(3)

    def weights(rows: np.ndarray) -> np.ndarray:
        zr = z[rows]
        return np.where(
            np.abs(zr) <= L1, 0.0, -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)
        )

    for _ in range(EPOCHS):
        order = rng.permutation(len(vectors))
        for at in range(0, len(order), BATCH):
            batch = [vectors[i] for i in order[at : at + BATCH]]
            rows, where = np.unique(np.concatenate([f for f, _, _ in batch]), return_inverse=True)
            w, gradient = weights(rows), np.zeros((len(rows), n_classes))
            begin = 0
            for features, x, label in batch:
                own = where[begin : begin + len(features)]
                begin += len(features)
                error = _softmax(x @ w[own])
                error[label] -= 1
                gradient[own] += x[:, None] * error
            gradient /= len(batch)
            step = (np.sqrt(n[rows] + gradient**2) - np.sqrt(n[rows])) / ALPHA
            z[rows] += gradient - step * w
            n[rows] += gradient**2
    return weights(np.arange(1 << FEATURE_BITS)).astype(np.float32)


def fit_temperature(vectors: Sequence[Vector], w: np.ndarray) -> float:
    """The temperature of the smallest cross-entropy, by a narrowing grid over its logarithm.

    Every class counts once more than it occurs, so that a sample without an error does not ask for certainty.
    """
    if not vectors:
        return 1.0
    logits = np.array([x @ w[f] for f, x, _ in vectors])
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (n + classes))
    target[np.arange(n), [label for _, _, label in vectors]] = (n + 1) / (n + classes)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(-(target * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum(axis=1).mean())

    low, high = -3.0, 3.0
    for _ in range(8):
        grid = np.linspace(low, high, 9)
        best = int(np.argmin([loss(g) for g in grid]))
        low, high = grid[max(0, best - 1)], grid[min(8, best + 1)]
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # idf and temperature included

    def predict(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(class number or -1, probability) of every text."""
        logits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for doc, feature in _ngrams(texts, ORDERS):
            for c in range(len(self.langs)):
                logits[:, c] += np.bincount(doc, self.weights[c, feature], len(texts))
            total += np.bincount(doc, minlength=len(texts))
        p = _softmax(logits / np.maximum(total, 1)[:, None])
        best = p.argmax(axis=1)
        letters = np.array([any(map(str.isalpha, t.decode())) if t else False for t in texts], bool)
        return np.where(letters, best, -1), np.where(letters, p[np.arange(len(texts)), best], 0.0)


def _held_out():
    """Rows without an id are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(True))


def _sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """lang, place, part of the ``per_lang`` distinct texts of every language with the smallest hash (``place``).

    Every fourth of a language is part 0, the first three never are. Only hashes are ranked, and of a language with
    many texts about four times the sample.
    """
    places = rows.select("lang", "place")
    cuts = places.groupBy("lang").agg(F.approx_count_distinct("place").alias("texts"))
    cuts = stored(cuts.select("lang", (4.0 * per_lang / F.greatest("texts", F.lit(1))).alias("share")), "cuts")
    near = places.join(cuts, "lang").where(F.col("place") < F.least("share", F.lit(1.0)) * float(1 << 62)).select("lang", "place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    ranked = near.distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang)
    return ranked.select("lang", "place", (F.col("rank") % 4).cast("int").alias("part"))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel | None:
    """A model of the languages of ``docs``; None if no row has both text and language.

    The sample: of the rows not held out, the ``per_lang`` smallest of every language by hash of doc_id and text, of
    any length; a quarter of them for calibration.
    """
    spark = docs.sparkSession
    rows = docs.where(~_held_out()).where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = rows.select("text").mapInArrow(_frequencies, FREQUENCY_SCHEMA).groupBy("feature").agg(F.sum("n").alias("n"))
    frequency, texts = np.zeros(1 << FEATURE_BITS), 0
    for row in counts.collect():  # 2**18 + 1 rows at most
        if row["feature"] < 0:
            texts = row["n"]
        else:
            frequency[row["feature"]] = row["n"]
    idf = np.log((1 + texts) / (1 + frequency)) + 1
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    rows = rows.select("text", "lang", place.alias("place"))
    sample = rows.join(stored(_sample(rows, per_lang), "sample"), ["lang", "place"]).select("lang", "place", "part", "text")
    vectors = sample.mapInArrow(_vectors(spark.sparkContext.broadcast(idf)), VECTOR_SCHEMA)
    # Rows that agree in all columns are one text.
    taken = stored(vectors.dropDuplicates(["lang", "place"]), "vectors")
    index = []
    with tempfile.TemporaryFile() as file:
        for r in taken.toLocalIterator():
            data = bytes(r["features"]) + bytes(r["weights"])
            index.append((r["lang"], r["part"], len(data) // 8, hashlib.sha256(data).digest(), file.tell()))
            file.write(data)
        index.sort()
        langs = sorted({lang for lang, *_ in index})
        if not langs:
            return None
        number = {lang: i for i, lang in enumerate(langs)}
        learned = Spilled(file, [(number[lang], at, n) for lang, part, n, _, at in index if part])
        w = fit_ftrl(learned, len(langs))
        t = fit_temperature(Spilled(file, [(number[lang], at, n) for lang, part, n, _, at in index if not part]), w)
    return LanguageModel(langs, np.ascontiguousarray((w * (SCALE / t * idf[:, None])).T.astype(np.float32)))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text, or one without any letter, is ``und`` with score 0, as is every text if there was nothing to learn
    from. The prediction sees the whole text only. Rows with a null doc_id count as held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, texts in text_chunks(batch, "text", CHUNK_BYTES // 2):
                best, score = m.predict(texts) if m else (np.full(len(texts), -1), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, len(texts)),
                        batch["held_out"].slice(first, len(texts)),
                        pa.array([m.langs[b] if b >= 0 else UNKNOWN for b in best.tolist()], pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, RESULT_SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageModel | None, min_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified with ``min_score`` or more; ``und`` goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch, "text", CHUNK_BYTES // 2):
                if shared.value:
                    best, score = shared.value.predict(texts)
                    yield batch.slice(first, len(texts)).filter(pa.array((best >= 0) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)
