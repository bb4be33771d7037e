"""Benchmark items that documents contain: MinHash containment search over items partitioned by size.

The share of an item's shingles that a document has, its containment, is what a MinHash sketch of the item estimates
without bias, whatever the document's length: of the item's shingles with the smallest hashes, count those that the
document has. Items are partitioned by size (powers of two), and each partition has its own sketch length: with q
shingles at most, floor(q / 4) + 1. A document that has 75 % of an item's shingles then has at least one of its
sketch, so the search misses nothing; what it finds is verified on the exact shingles.

The sketches go to the tasks as a bitmap of fixed size. Only documents that hit a sketch give rows, and only for
shingles that some item may have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import stored
from loglake.llm.words import Words, shingles, split_words, text_chunks

SHINGLE = 5
PERCENT = 75
BITMAP_BITS = 23

ITEM_SCHEMA = "item_id long, n_item long, shingle string, hash long, in_sketch boolean"
HIT_SCHEMA = "doc_id long, shingle string"


def _lower(texts: list[bytes | None]) -> Words:
    return split_words([t and t.lower() for t in texts])


def _strings(w: Words, first: np.ndarray, count: np.ndarray) -> list[str]:
    data = w.buf.tobytes()
    return [data[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first + count - 1].tolist())]


def sketch_length(n: int) -> int:
    """Shingles in the sketch of an item of ``n`` shingles, by the largest size in its partition."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest * (100 - PERCENT) // 100 + 1)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["item_id"].to_pylist()
        for begin, texts in text_chunks(batch, "text"):
            w = _lower(texts)
            first, count, hashes = shingles(w, SHINGLE)
            rows: list[dict] = []
            for item in np.unique(w.doc[first]).tolist():
                own = np.flatnonzero(w.doc[first] == item)
                names = dict(zip(_strings(w, first[own], count[own]), hashes[own].tolist()))
                length = sketch_length(len(names))
                for k, (name, h) in enumerate(sorted(names.items(), key=lambda x: (x[1], x[0]))):
                    signed = h - (1 << 64) if h >> 63 else h
                    rows.append(
                        {"item_id": ids[begin + item], "n_item": len(names), "shingle": name, "hash": signed, "in_sketch": k < length}
                    )
            if rows:
                yield pa.RecordBatch.from_pylist(rows)


def _hits(bitmaps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, items = (np.frombuffer(b, np.uint8) for b in bitmaps.value)

        def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            at = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for begin, texts in text_chunks(batch, "text"):
                w = _lower(texts)
                first, count, hashes = shingles(w, SHINGLE)
                candidate = np.zeros(w.n_docs, bool)
                candidate[w.doc[first[has(sketch, hashes)]]] = True
                chosen = np.flatnonzero(candidate[w.doc[first]])
                chosen = chosen[has(items, hashes[chosen])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[begin + w.doc[first[chosen]]], pa.int64()),
                        pa.array(_strings(w, first[chosen], count[chosen]), pa.string()),
                    ],
                    ["doc_id", "shingle"],
                )

    return run


def _bitmap(hashes: DataFrame) -> bytes:
    """One bit for the leading bits of each hash; its size is fixed."""
    lead = F.shiftrightunsigned("hash", 64 - BITMAP_BITS) + 1
    parts = (
        hashes.groupBy(F.bitmap_bucket_number(lead).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(lead)).alias("bits"))
        .collect()
    )
    table = bytearray((1 << BITMAP_BITS) // 8)
    for part in parts:
        at = (part["bucket"] - 1) * 4096  # bucket b begins at number (b - 1) * 32768 + 1
        table[at : at + 4096] = part["bits"]
    return bytes(table)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every document that has 75 % or more of an item's shingles.

    Shingles are 5 words, A-Z lower-cased; a text of fewer words is one shingle as a whole, so a very short item is
    only found in a document that consists of it. Null and empty texts have no shingles; rows whose doc_id or item_id
    is null are left out. Rows with equal ids are one document or item. Only doc_id, item_id and text are read.
    """
    rows = benchmark.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(_items, ITEM_SCHEMA)
    items = stored(
        rows.groupBy("item_id", "shingle").agg(
            F.max("n_item").alias("n_item"), F.max("hash").alias("hash"), F.max("in_sketch").alias("in_sketch")
        ),
        "items",
    )
    bitmaps = docs.sparkSession.sparkContext.broadcast((_bitmap(items.where("in_sketch")), _bitmap(items)))
    hits = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_hits(bitmaps), HIT_SCHEMA).distinct()
    return (
        stored(hits, "hits")
        .join(items.drop("hash"), "shingle")
        .groupBy("doc_id", "item_id")
        .agg(F.count("shingle").alias("n_shared"), F.max("n_item").alias("n_item"), F.max("in_sketch").alias("found"))
        .where(f"found AND 100 * n_shared >= {PERCENT} * n_item")
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


OP3_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
  ) AS ws FROM t
), s AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM s d JOIN s i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes ON sizes.id = item_id WHERE 100 * n_shared >= 75 * n_item
"""
