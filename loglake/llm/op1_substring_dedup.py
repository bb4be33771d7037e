"""Removal of passages that an earlier document has: exact windows behind a count-min prefilter.

1. Documents are packed into blocks of whole texts, written once to the shared folder, so that every later pass
   sees the same blocks.
2. Every task counts the windows of its blocks in a count-min sketch (two rows). The sketches travel as sorted cells
   per shard and are added up; what is kept of the sum is one bit per cell: counted in two documents or more.
   The sketch has about four cells a window, 2**29 a row at most; past that it lets more windows through.
3. Windows whose cells are set in both rows - all repeated ones and a few more - are named by a 96-bit digest of
   their words. Each block sends a key once, with its smallest doc_id, packed by parts of the key space; the task
   of a part groups its keys and answers each block with a bit per key: also in a smaller doc_id.
4. Each block gets its answers and cuts its texts.

A key thus has as many rows as blocks that hold it, however often it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import LAST_ID, stored
from loglake.llm.words import CHUNK_BYTES, Words, mix, split_words, text_chunks, window_hashes

WINDOW = 13
BLOCK_BYTES = 2 * CHUNK_BYTES
MAX_ROW_BITS = 29
SHARD_BITS = 22
FLUSH_CELLS = 4_000_000
ROW_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

BLOCK_SCHEMA = "block long, ids binary, sizes binary, texts binary, n_windows long"
CELL_SCHEMA = "shard int, once binary, more binary"
KEY_SCHEMA = "part int, block long, n int, keys binary"
ANSWER_SCHEMA = "block long, part int, later binary"
PART_WINDOWS = 1 << 18
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _record(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in text_chunks(batch, "text", BLOCK_BYTES):
                ids = batch["doc_id"].slice(first, len(texts))
                null = np.asarray(ids.is_null())
                w = split_words(texts)
                yield _record(
                    {
                        "block": [block],
                        "ids": [ids.fill_null(LAST_ID).to_numpy().astype("<i8").tobytes() + null.tobytes()],
                        "sizes": [np.array([len(t or b"") for t in texts], "<i8").tobytes()],
                        "texts": [zstandard.compress(b"".join(t or b"" for t in texts), 1)],
                        "n_windows": [int(np.maximum(w.per_doc() - size + 1, 0).sum())],
                    },
                    BLOCK_SCHEMA,
                )
                block += 1

    return run


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words]]:
    """block, doc_ids, whether each is null, words - of every row."""
    for row in range(batch.num_rows):
        sizes = np.frombuffer(batch["sizes"][row].as_py(), "<i8")
        raw = batch["ids"][row].as_py()
        ids, null = np.frombuffer(raw[: 8 * len(sizes)], "<i8"), np.frombuffer(raw[8 * len(sizes) :], bool)
        data, bounds = zstandard.decompress(batch["texts"][row].as_py()), np.concatenate(([0], np.cumsum(sizes)))
        texts = [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield batch["block"][row].as_py(), ids, null, split_words(texts)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes * ROW_SEEDS[row]) >> np.uint64(64 - bits)


def _encode(cells: np.ndarray) -> bytes:
    """Sorted numbers as compressed byte planes of their gaps."""
    return zstandard.compress(np.diff(cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _decode(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _count(size: int, bits: int, shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            hashes = np.concatenate(held)
            held.clear()
            for row in range(len(ROW_SEEDS)):
                cells, counts = np.unique(_cells(hashes, row, bits), return_counts=True)
                shards = (cells >> np.uint64(shard_bits)).astype(np.int64)
                inside = (cells & np.uint64((1 << shard_bits) - 1)).astype(np.int64)
                bounds = np.searchsorted(shards, np.arange((1 << (bits - shard_bits)) + 1))
                for shard in np.unique(shards).tolist():
                    part = slice(bounds[shard], bounds[shard + 1])
                    many = counts[part] > 1
                    yield _record(
                        {
                            "shard": [(row << (bits - shard_bits)) + shard],
                            "once": [_encode(inside[part][~many])],
                            "more": [_encode(inside[part][many])],
                        },
                        CELL_SCHEMA,
                    )

        for batch in batches:
            for _, ids, _, w in _blocks(batch):
                first, hashes = window_hashes(w, size)
                # A window counts once per document: equal neighbours after sorting by hash and document go.
                doc = ids[w.doc[first]]
                order = np.lexsort((doc, hashes))
                hashes, doc = hashes[order], doc[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                held.append(hashes[new])
                if sum(map(len, held)) >= FLUSH_CELLS:
                    yield from flush()
        yield from flush()

    return run


def _merge(shard_bits: int):
    """Add up the sketches of one shard after another; rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, current = np.zeros(1 << shard_bits, np.uint8), None

        def done() -> pa.RecordBatch:
            return _record({"shard": [current], "bits": [np.packbits(counters > 1).tobytes()]}, "shard int, bits binary")

        for batch in batches:
            for shard, once, more in zip(*(batch[c].to_pylist() for c in ("shard", "once", "more"))):
                if shard != current:
                    if current is not None:
                        yield done()
                        counters[:] = 0
                    current = shard
                one, many = _decode(once), _decode(more)
                counters[one] = np.minimum(counters[one] + 1, 2)
                counters[many] = 2
        if current is not None:
            yield done()

    return run


@dataclass
class Sketch:
    """The bits of the merged sketch, one string a row; compressed on its way to the tasks."""

    rows: list[bytes]

    def __getstate__(self) -> list[bytes]:
        return [zstandard.compress(bytes(r), 1) for r in self.rows]

    def __setstate__(self, state: list[bytes]) -> None:
        self.rows = [zstandard.decompress(r) for r in state]


def _estimated(hashes: np.ndarray, sketch: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether the smallest of the estimates is two or more."""
    hit = np.ones(len(hashes), bool)
    for row, table in enumerate(sketch):
        left = np.flatnonzero(hit)
        cells = _cells(hashes[left], row, bits)
        hit[left] = (table[cells >> np.uint64(3)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1
    return hit


@dataclass
class Keys:
    """The windows of a block that may be repeated: key ``of[i]`` begins at word ``first[i]``, in document ``doc[i]``.

    Keys are the leading 96 bits (hi, lo) of a digest of the words, in ascending order.
    """

    hi: np.ndarray
    lo: np.ndarray
    min_doc: np.ndarray
    of: np.ndarray
    first: np.ndarray
    doc: np.ndarray


def _block_keys(ids: np.ndarray, w: Words, size: int, sketch: list[np.ndarray], bits: int) -> Keys:
    first, hashes = window_hashes(w, size)
    first = first[_estimated(hashes, sketch, bits)]
    data, digest = w.buf.tobytes(), xxhash.xxh3_128_digest
    names = b"".join(
        digest(data[a:b]) for a, b in zip(w.start[first].tolist(), w.end[first + size - 1].tolist())
    )
    parts = np.frombuffer(names, ">u4").reshape(-1, 4).astype(np.uint64)
    hi, lo, doc = (parts[:, 0] << np.uint64(32)) | parts[:, 1], parts[:, 2], ids[w.doc[first]]
    order = np.lexsort((doc, lo, hi))
    hi, lo, doc, first = hi[order], lo[order], doc[order], first[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return Keys(hi[new], lo[new], doc[new], np.cumsum(new) - 1, first, doc)


def _sketch_rows(sketch) -> list[np.ndarray]:
    return [np.frombuffer(r, np.uint8) for r in sketch.value.rows]


def _part_of(hi: np.ndarray, parts: int) -> np.ndarray:
    return ((hi >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _planes(numbers: np.ndarray, kind: str) -> bytes:
    return numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def _keys(size: int, bits: int, sketch, parts: int):
    """One row for each block and part of the key space: keys and smallest doc_ids as compressed byte planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _sketch_rows(sketch)
        for batch in batches:
            for block, ids, _, w in _blocks(batch):
                k = _block_keys(ids, w, size, rows, bits)
                part = _part_of(k.hi, parts)
                bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                out: dict[str, list] = {"part": [], "block": [], "n": [], "keys": []}
                for a, b in zip(bounds[:-1], bounds[1:]):
                    if b > a:
                        data = _planes(k.hi[a:b], ">u8") + _planes(k.lo[a:b], ">u4") + _planes(k.min_doc[a:b], ">i8")
                        for name, value in zip(out, (int(part[a]), block, b - a, zstandard.compress(data, 1))):
                            out[name].append(value)
                yield _record(out, KEY_SCHEMA)

    return run


def _answers(rows: list[tuple[int, int, bytes]], part: int) -> pa.RecordBatch:
    """For each block of one part of the key space, which of its keys also start in a smaller doc_id elsewhere."""
    hi, lo, doc = [], [], []
    for _, n, data in rows:
        planes = np.frombuffer(zstandard.decompress(data), np.uint8)
        for target, at, width, kind in ((hi, 0, 8, ">u8"), (lo, 8, 4, ">u4"), (doc, 12, 8, ">i8")):
            values = np.ascontiguousarray(planes[at * n : (at + width) * n].reshape(width, n).T).view(kind).ravel()
            target.append(values.astype(kind[1:]))
    hi, lo, doc = np.concatenate(hi), np.concatenate(lo), np.concatenate(doc)
    order = np.lexsort((doc, lo, hi))
    hi, lo, ordered = hi[order], lo[order], doc[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    later = np.empty(len(hi), bool)
    later[order] = ordered > ordered[new][np.cumsum(new) - 1]
    ends = np.cumsum([n for _, n, _ in rows])
    answers = [np.packbits(x).tobytes() for x in np.split(later, ends[:-1])]
    return _record({"block": [b for b, _, _ in rows], "part": [part] * len(rows), "later": answers}, ANSWER_SCHEMA)


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part; one part is held at a time."""
    current, held = None, []
    for batch in batches:
        for part, *row in zip(*(batch[c].to_pylist() for c in ("part", "block", "n", "keys"))):
            if part != current and held:
                yield _answers(held, current)
                held = []
            current = part
            held.append(tuple(row))
    if held:
        yield _answers(held, current)


def _covered(w: Words, k: Keys, later: np.ndarray, size: int) -> np.ndarray:
    """Words inside a window that also starts in an earlier document, here or - where ``later`` says so - elsewhere."""
    starts = k.first[later[k.of] | (k.doc > k.min_doc[k.of])]
    edges = np.zeros(len(w.start) + 1, np.int64)
    edges[starts] += 1  # a word begins one window
    edges[starts + size] -= 1
    return np.cumsum(edges[:-1]) > 0


def _cut(size: int, bits: int, sketch, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _sketch_rows(sketch)
        for batch in batches:
            answers = batch["answers"].to_pylist()
            for row, (_, ids, null, w) in enumerate(_blocks(batch)):
                k = _block_keys(ids, w, size, rows, bits)
                later, part = np.zeros(len(k.hi), bool), _part_of(k.hi, parts)
                for answer in answers[row] or []:
                    a, b = np.searchsorted(part, [answer["part"], answer["part"] + 1])
                    later[a:b] = np.unpackbits(np.frombuffer(answer["later"], np.uint8), count=b - a)
                drop = _covered(w, k, later, size)
                kept = w.buf[np.repeat(~drop, w.end - w.start + 1)].tobytes()
                left = np.bincount(w.doc[~drop], weights=(w.end - w.start + 1)[~drop], minlength=w.n_docs)
                bounds = np.concatenate(([0], np.cumsum(left.astype(np.int64)))).tolist()
                yield _record(
                    {
                        "doc_id": [None if n else i for i, n in zip(ids.tolist(), null.tolist())],
                        "n_words": w.per_doc(),
                        "n_removed": np.bincount(w.doc[drop], minlength=w.n_docs),
                        "kept_sha256": [
                            hashlib.sha256(kept[a : max(a, b - 1)]).hexdigest()
                            for a, b in zip(bounds[:-1], bounds[1:])
                        ],
                    },
                    RESULT_SCHEMA,
                )

    return run


def remove_repeated_passages(
    docs: DataFrame, window: int = WINDOW, max_row_bits: int = MAX_ROW_BITS, shard_bits: int = SHARD_BITS
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text; other columns are ignored).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    Null and empty texts have no words and keep the digest of the empty text. A null doc_id is larger than any other.
    Rows with equal doc_id are judged one by one and don't affect each other.
    """
    spark = docs.sparkSession
    blocks = stored(docs.select("doc_id", "text").mapInArrow(_pack(window), BLOCK_SCHEMA), "blocks")
    n = blocks.agg(F.sum("n_windows")).first()[0] or 0
    bits = min(max_row_bits, max(shard_bits, (4 * n).bit_length()))
    per_row = 1 << (bits - shard_bits)
    merged = (
        blocks.mapInArrow(_count(window, bits, shard_bits), CELL_SCHEMA)
        .repartition(max(1, len(ROW_SEEDS) * per_row // 4), "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_merge(shard_bits), "shard int, bits binary")
    )
    # At most 2 * 2**max_row_bits bits pass the driver, one shard at a time.
    rows = [bytearray(1 << (bits - 3)) for _ in ROW_SEEDS]
    width = 1 << (shard_bits - 3)
    for shard in merged.toLocalIterator(prefetchPartitions=True):
        row, at = divmod(shard["shard"], per_row)
        rows[row][at * width : (at + 1) * width] = shard["bits"]
    sketch = spark.sparkContext.broadcast(Sketch(rows))
    parts = max(1, n // PART_WINDOWS)
    keys = blocks.mapInArrow(_keys(window, bits, sketch, parts), KEY_SCHEMA)
    answers = (
        keys.repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_group, ANSWER_SCHEMA)
        .groupBy("block")
        .agg(F.collect_list(F.struct("part", "later")).alias("answers"))
    )
    return blocks.join(answers, "block", "left").mapInArrow(_cut(window, bits, sketch, parts), RESULT_SCHEMA)


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), pos AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM pos
), firsts AS (
  SELECT k, min(doc_id) AS d0 FROM win GROUP BY k
), dup AS (
  SELECT win.doc_id, win.i FROM win JOIN firsts USING (k) WHERE d0 < win.doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM dup) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w
), kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY j) AS txt
  FROM words LEFT JOIN gone USING (doc_id) WHERE js IS NULL OR NOT list_contains(js, j) GROUP BY words.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
