"""Exact top-k inner products over a bit-sliced index.

Vectors are turned into integers floor(256 x) and cut into blocks. A block's index holds each attribute, less its
smallest value in the block, by its six leading bits: one bitmap over the block's rows per bit. A query adds the slices,
shifted by the bits of its own components, with carry-save adders on bitmaps; negative components take the
complemented slices. From the most significant slice of the sum downward the rows with the largest sums are selected;
all rows whose true score may reach the k-th of them, given what the dropped bits can add, are resolved exactly.

Every group of queries meets every block; each block gives k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.llm.common import stored

SCALE = 256
SLICES = 6
BLOCK_ROWS = 8192
QUERY_ROWS = 128

BLOCK_SCHEMA = "block long, dim int, ids binary, ints binary, base binary, dropped binary, slices binary"
QUERY_SCHEMA = "q_dim int, q_keys binary, q_ids binary, q_ints binary"
SCORE_SCHEMA = "query long, query_id long, vec_id long, score long, own boolean"
# Vectors with a larger sum of squared integers take no part: no score of the others leaves 64 bits.
MAX_SQUARE = float(1 << 62)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, keys, ids, integers) of up to ``limit`` rows of one dimension."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def take(dim: int) -> tuple:
        return dim, *(np.concatenate(part) for part in zip(*held.pop(dim)))

    for batch in batches:
        sizes = pc.list_value_length(batch["embedding"]).to_numpy()
        for dim in np.unique(sizes).tolist():
            rows = batch.filter(pa.array(sizes == dim))
            values = rows["embedding"].flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            ints = np.floor(SCALE * values).astype(np.int64)
            keys, ids = rows["query"].to_numpy(), rows["vec_id"].to_numpy()
            for at in range(0, len(ids), limit):
                part = slice(at, at + limit)
                held.setdefault(dim, []).append((keys[part], ids[part], ints[part]))
                if sum(len(i) for i, *_ in held[dim]) >= limit:
                    yield take(dim)
    for dim in list(held):
        yield take(dim)


def _bitmaps(rows: np.ndarray) -> np.ndarray:
    """Boolean (..., rows) as 64-bit words."""
    packed = np.packbits(rows, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view("<u8")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for dim, _, ids, ints in _gathered(batches, BLOCK_ROWS):
        base = ints.min(axis=0)
        dropped = np.array([max(0, int(x).bit_length() - SLICES) for x in ints.max(axis=0) - base])
        leading = ((ints - base) >> dropped).T
        slices = np.stack([_bitmaps((leading >> b) & 1 == 1) for b in range(SLICES)], axis=1)
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block]), "dim": pa.array([dim], pa.int32()), "ids": [ids.astype("<i8").tobytes()],
                "ints": [ints.astype("<i8").tobytes()], "base": [base.astype("<i8").tobytes()],
                "dropped": [dropped.astype("<i8").tobytes()], "slices": [slices.tobytes()],
            }
        )
        block += 1


def _query_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, *parts in _gathered(batches, QUERY_ROWS):
        columns = {n: [p.astype("<i8").tobytes()] for n, p in zip(("q_keys", "q_ids", "q_ints"), parts)}
        yield pa.RecordBatch.from_pydict({"q_dim": pa.array([dim], pa.int32())} | columns)


def add_slices(planes: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices of sum(weights[d] * number d) with ``planes`` (d, slice, words) and non-negative weights."""
    columns: dict[int, list[np.ndarray]] = {}
    for j in range(int(weights.max(initial=0)).bit_length()):
        chosen = planes[(weights >> j) & 1 == 1]
        for b in range(planes.shape[1]):
            columns.setdefault(j + b, []).append(chosen[:, b])
    out: list[np.ndarray] = []
    place = 0
    while any(p >= place for p in columns):
        bitmaps = np.concatenate(columns.pop(place, [np.zeros((0, planes.shape[2]), np.uint64)]))
        while len(bitmaps) > 1:
            third = max(1, len(bitmaps) // 3)
            a, b = bitmaps[:third], bitmaps[third : 2 * third]
            c, rest = bitmaps[2 * third : 3 * third], bitmaps[3 * third :]
            if not len(c):
                c = np.zeros_like(a)
            odd = a ^ b
            columns.setdefault(place + 1, []).append((a & b) | (odd & c))
            bitmaps = np.concatenate((odd ^ c, rest))
        out.append(bitmaps[0] if len(bitmaps) else np.zeros(planes.shape[2], np.uint64))
        place += 1
    return out


def kth_largest(sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``rows`` (a bitmap of k rows at least), from the most significant slice downward."""
    value, sure, equal = 0, 0, rows
    for place in range(len(sums) - 1, -1, -1):
        ones = equal & sums[place]
        n = int(np.bitwise_count(ones).sum())
        if sure + n >= k:
            equal, value = ones, value | 1 << place
        else:
            sure, equal = sure + n, equal & ~sums[place]
    return value


def at_least(sums: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """Those of ``rows`` whose sum is ``bound`` or more."""
    if bound <= 0:
        return rows
    if bound >> len(sums):
        return np.zeros_like(rows)
    more, equal = np.zeros_like(rows), rows
    for place in range(len(sums) - 1, -1, -1):
        if bound >> place & 1:
            equal = equal & sums[place]
        else:
            more, equal = more | (equal & sums[place]), equal & ~sums[place]
    return more | equal


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch[name][r].as_py() for name in batch.schema.names}
                dim, ids = row["dim"], np.frombuffer(row["ids"], "<i8")
                if dim != row["q_dim"]:
                    continue
                ints = np.frombuffer(row["ints"], "<i8").reshape(-1, dim)
                base, dropped = np.frombuffer(row["base"], "<i8"), np.frombuffer(row["dropped"], "<i8")
                plain = np.frombuffer(row["slices"], "<u8").reshape(dim, SLICES, -1)
                flipped = ~plain
                slack = (1 << dropped) - 1
                every = _bitmaps(np.ones(len(ids), bool))
                q_keys, q_ids = np.frombuffer(row["q_keys"], "<i8").tolist(), np.frombuffer(row["q_ids"], "<i8").tolist()
                for key, query_id, q in zip(q_keys, q_ids, np.frombuffer(row["q_ints"], "<i8").reshape(-1, dim)):
                    rows = every
                    if len(ids) > k:
                        planes = np.where((q < 0)[:, None, None], flipped, plain)
                        sums = add_slices(planes, np.abs(q) << dropped)
                        # A row's score is its sum plus a constant plus what the dropped bits add: low to high.
                        width = sum(map(int.__mul__, np.abs(q).tolist(), slack.tolist()))
                        rows = at_least(sums, rows, kth_largest(sums, rows, k) - width)
                    chosen = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little", count=len(ids)))
                    scores = ints[chosen] @ q
                    best = np.lexsort((ids[chosen], -scores))[:k]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query": np.full(len(best), key), "query_id": np.full(len(best), query_id),
                            "vec_id": ids[chosen[best]], "score": scores[best],
                            "own": (ids[chosen[best]] == query_id) & (scores[best] == q @ q),
                        }
                    )

    return run


def top_k(vectors: DataFrame, is_query: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query row with all other rows.

    ``vectors`` has vec_id and embedding (other columns are ignored); ``is_query`` is a condition on vec_id. Ties go
    to the smaller vec_id. Null vec_ids and vectors that are null, empty, hold null or non-finite components, or whose
    integers' squares add up to ``MAX_SQUARE`` or more, take no part; vectors meet those of their own length only. A row is
    a row: of repeated rows and of rows with equal vec_id each is a query of its own and a candidate of the others. Equal
    query rows are searched once and written as often as they occur.
    """
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(SCALE * x.cast("double")).cast("double"), 2))
    usable = vectors.select("vec_id", "embedding").where(
        "vec_id IS NOT NULL AND size(embedding) > 0 "
        "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    ).where(squares < MAX_SQUARE).withColumn("query", F.xxhash64("vec_id", "embedding"))
    blocks = stored(usable.mapInArrow(_index, BLOCK_SCHEMA), "slices")
    queries = usable.where(is_query).groupBy("query").agg(
        F.first("vec_id").alias("vec_id"), F.first("embedding").alias("embedding"), F.count("*").alias("copies")
    )
    queries = stored(queries, "queries")
    groups = stored(queries.mapInArrow(_query_groups, QUERY_SCHEMA), "query_groups")
    # The one place where all meets all: groups of queries and blocks of rows, partition by partition. Lengths are
    # compared afterwards, as a join on them would bring everything to one task.
    scores = blocks.crossJoin(groups).mapInArrow(_search(k + 1), SCORE_SCHEMA)
    # Of the k + 1 best rows the query's own, or a copy that looks the same, goes; if it is not there, the last one.
    best = scores.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    best = best.where(f"place <= {k + 1}")
    itself = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    ranked = best.withColumn("itself", itself).where("itself IS NULL OR place <> itself")
    rank = F.col("place") - F.coalesce((F.col("place") > F.col("itself")).cast("int"), F.lit(0))
    found = ranked.withColumn("rank", rank).where(f"rank <= {k}").join(queries.select("query", "copies"), "query")
    every = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP9_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT * FROM v WHERE len(e) > 0 AND list_sum(list_transform(e, lambda x: x * x)) < {MAX_SQUARE:.0f}
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM u q JOIN u c ON q.row <> c.row WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
