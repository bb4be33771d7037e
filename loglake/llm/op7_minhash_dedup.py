"""Near-duplicate groups by min-max hashing.

Every document's set of 5-word shingles is hashed by 130 permutations; of each the smallest and the largest value are
kept, 260 values from 130 evaluations. Five values make a band: one of minima and one of maxima for every five
permutations, 52 bands. Two sets with similarity s share a band with probability 1 - (1 - s**5)**52; at 0.75 that
misses fewer than one pair in a million.

Identical sets are collapsed first. Of the documents that share a band, each is compared on its full set with the
smallest; the links found give components. Where a band still holds several components, its documents are compared
again in groups of bounded size, each by counting the shared shingles of all its documents at once; only links between
components leave a group. So no link is lost, and no list of pairs is made that grows with the square of a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import stored
from loglake.llm.components import components
from loglake.llm.words import mix, shingle_sets, split_words, text_chunks

PERMUTATIONS = 130
ROWS = 5
PERCENT = 75
SHINGLE = 5
SINGLES = 10
CHUNK = 200_000
GROUP_DOCS = 2000
SHORT = 128
TILE = 256
COLUMNS = 4096
MARK_BITS = 27

_rng = np.random.default_rng(17)
_FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, hi long, lo long, bands array<long>"
SET_SCHEMA = "doc_id long, n long, shingles array<long>"


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band keys (one row each) of the non-empty sets hashes[bounds[i]:bounds[i + 1]]."""
    n = len(bounds) - 1
    keys = np.empty((n, 2 * PERMUTATIONS // ROWS), np.uint64)
    for group in range(PERMUTATIONS // ROWS):
        low = np.full(n, 2 * group, np.uint64)
        high = np.full(n, 2 * group + 1, np.uint64)
        for k in range(group * ROWS, (group + 1) * ROWS):
            permuted = hashes * _FACTORS[k] + _SHIFTS[k]
            low = mix(low ^ np.minimum.reduceat(permuted, bounds[:-1]))
            high = mix(high ^ np.maximum.reduceat(permuted, bounds[:-1]))
        keys[:, 2 * group], keys[:, 2 * group + 1] = low, high
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_chunks(batch, "text"):
            hashes, bounds = shingle_sets(split_words([t and t.lower() for t in texts]), SHINGLE)
            sizes = np.diff(bounds)
            full = sizes > 0
            names = np.zeros((len(texts), 2), "<i8")
            offsets = np.zeros(len(texts) + 1, np.int32)
            keys = np.zeros((0, 2 * PERMUTATIONS // ROWS), np.uint64)
            if full.any():
                keys = band_keys(hashes, np.concatenate((bounds[:-1][full], bounds[-1:])))
                data = hashes.astype("<u8").tobytes()
                digests = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                names = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                offsets[1:] = np.cumsum(full) * keys.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(first, len(texts)),
                    pa.array(sizes, pa.int64()),
                    pa.array(names[:, 0]),
                    pa.array(names[:, 1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))),
                ],
                ["doc_id", "n_shingles", "hi", "lo", "bands"],
            )


def _marked_sets(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            mark = batch["mark"].to_numpy()
            chosen = (table[mark >> 3] >> (mark & 7).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(chosen))
            for first, texts in text_chunks(batch, "text"):
                hashes, bounds = shingle_sets(split_words([t and t.lower() for t in texts]), SHINGLE)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, len(texts)),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    ],
                    ["doc_id", "n", "shingles"],
                )

    return run


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Full sets of the documents in ``ids`` (and of a few more: ids are looked up in a bitmap of 2**27 bits)."""
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << MARK_BITS)) + 1
    parts = (
        ids.groupBy(F.bitmap_bucket_number(mark).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark)).alias("bits"))
        .collect()
    )
    width = 4096
    marks = bytearray((1 << MARK_BITS) // 8)
    for part in parts:
        at = (part["bucket"] - 1) * width  # bucket b begins at number (b - 1) * 32768 + 1
        marks[at : at + width] = part["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(marks))
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", (mark - 1).alias("mark"))
    return stored(rows.mapInArrow(_marked_sets(shared), SET_SCHEMA), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough. ``a`` may be in very many pairs: that join can be split."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    close = F.expr(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    joined = pairs.join(right, "b").join(left, "a").where(close)
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return (
        joined.select("a", "b", "n_a", "n_b", shared.alias("shared"))
        .where(f"100 * shared >= {PERCENT} * (n_a + n_b - shared)")
        .select("a", "b")
    )


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document and single minimum, with the full set."""
    for batch in batches:
        shingles = batch["shingles"]
        sizes = pc.list_value_length(shingles).cast(pa.int64())
        hashes, bounds = shingles.flatten().to_numpy().view(np.uint64), np.cumsum([0, *sizes.to_pylist()])
        sets = pa.array([hashes[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())
        for k in range(SINGLES):
            low = np.minimum.reduceat(hashes * _FACTORS[k] + _SHIFTS[k], bounds[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(low ^ np.uint64(k)).view(np.int64)), batch["doc_id"], batch["component"], sizes, sets],
                ["block", "doc_id", "component", "n", "own"],
            )


def _links_within(table: pa.Table) -> pa.Table:
    """One link between any two components of the group that have one, by counting shared shingles of all at once."""
    ids, component = table["doc_id"].to_numpy(), table["component"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table["own"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts > 1
    number = np.cumsum(often) - 1
    owner, column = owner[often[column]], number[column[often[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)))
    for first in range(0, int(often.sum()), COLUMNS):
        x, y = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[x:y], column[x:y] - first] = 1
        shared += part @ part.T
    found = []
    for first in range(0, len(sets), TILE):
        tile = slice(first, first + TILE)
        close = 100 * shared[tile] >= PERCENT * (sizes[tile, None] + sizes[None, :] - shared[tile])
        x, y = np.nonzero(close & (component[tile, None] < component[None, :]))
        _, one = np.unique(np.stack((component[x + first], component[y])), axis=1, return_index=True)
        found.append((x[one] + first, y[one]))
    i, j = (np.concatenate(x) for x in zip(*found))
    _, one = np.unique(np.stack((component[i], component[j])), axis=1, return_index=True)
    return pa.table({"a": ids[i[one]], "b": ids[j[one]]})


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch["n"].to_numpy()
        shingles = np.frombuffer(b"".join(batch["own"].to_pylist()), "<i8")
        columns = [pa.array(np.repeat(batch[c].to_numpy(), sizes)) for c in ("block", "doc_id", "set", "n")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(shingles)], ["block", "doc_id", "set", "n", "shingle"])


def _split_blocks(rows: DataFrame, group_docs: int) -> DataFrame:
    """``rows`` with blocks of more than ``group_docs`` documents divided by rare shingles.

    Of two sets alike enough, the rarest shingles - one more than a set may lack - have one in common, in any order of
    rarity. Sets of up to SHORT shingles meet under each of those; longer ones, and those next to them in size, stay
    in the block, which the number of shingles cuts.
    """
    hot = stored(
        rows.groupBy("block")
        .agg(F.count("*").alias("docs"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where((F.col("docs") > group_docs) & (F.col("low") != F.col("high")))
        .select("block"),
        "hot",
    )
    if hot.isEmpty():
        return rows
    short = rows.join(hot, "block", "left_semi").where(F.col("n") <= SHORT).withColumn("set", F.xxhash64("own"))
    short = stored(short, "short")
    shingles = stored(short.mapInArrow(_shingle_rows, "block long, doc_id long, set long, n long, shingle long"), "shingles")
    often = stored(shingles.groupBy("block", "shingle").agg(F.count("*").alias("often")), "often")
    least = F.expr(f"slice(array_distinct(sort_array(collect_list(struct(often, shingle)))), 1, int(first(n) - ({PERCENT} * first(n) + 99) div 100 + 1))")
    rare = shingles.join(often, ["block", "shingle"]).groupBy("block", "doc_id", "set").agg(least.alias("rare"))
    divided = (
        short.join(rare.select("block", "doc_id", "set", F.explode("rare.shingle").alias("shingle")), ["block", "doc_id", "set"])
        .withColumn("block", F.xxhash64("block", "shingle"))
        .select(*rows.columns)
    )
    whole = rows.join(hot, "block", "left_anti").unionByName(
        rows.join(hot, "block", "left_semi").where(f"100 * n > {PERCENT * SHORT}")
    )
    return stored(whole.unionByName(divided), "divided")


def _remaining_links(members: DataFrame, groups: DataFrame, sets: DataFrame, chunk: int, group_docs: int) -> DataFrame:
    """Links between different components of a bucket that the comparison with its smallest document left open.

    Documents of such buckets are blocked anew by each of ten single minima (at 0.75 all ten differ for one pair in a
    million). Blocks of many documents are divided by rare shingles. A block is cut into chunks of about ``chunk`` shingles
    and ``group_docs`` documents, at most, by doc_id hash; each two chunks meet once, in a group of bounded size.
    """
    known = members.join(groups, members["doc_id"] == groups["id"], "left").select(
        "bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    known = stored(known, "known")
    unsettled = (
        known.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("n > 2 AND low <> high")
        .select("bucket")
    )
    docs = known.join(stored(unsettled, "unsettled"), "bucket").select("doc_id", "component").distinct()
    rows = stored(
        sets.where("n > 0").join(docs, "doc_id").select("doc_id", "component", "shingles").mapInArrow(
            _block_rows, "block long, doc_id long, component long, n long, own binary"
        ),
        "blocks",
    )
    rows = _split_blocks(rows, group_docs)
    parts = (
        rows.groupBy("block")
        .agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("block", F.ceil(F.greatest(F.col("n") / chunk, F.col("docs") / group_docs)).cast("int").alias("chunks"))
    )
    mine = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    met = (
        rows.join(stored(parts, "parts"), "block")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("block", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "doc_id", "component", "own")
    )
    return met.groupBy("block", "x", "y").applyInArrow(_links_within, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, chunk: int = CHUNK, group_docs: int = GROUP_DOCS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked whose sets of 5-word shingles (A-Z lower-cased) have a similarity of 0.75 or more;
    component_id is the smallest doc_id that links reach, and the document of that id is kept. Documents of fewer
    words have the whole sequence as one shingle; null and empty texts have an empty set and no links. Rows with
    equal doc_id are one document for linking and get one row each. A null doc_id has no links, component_id null,
    and is kept.
    """
    signatures = stored(docs.select("doc_id", "text").mapInArrow(_signatures, SIGNATURE_SCHEMA), "signatures")
    linked = signatures.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(linked.groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id")), "classes")
    firsts = linked.join(classes, ["hi", "lo"]).where("doc_id = first_id").select("doc_id", "bands")
    rows = firsts.select(F.explode("bands").alias("bucket"), "doc_id")
    centres = (
        rows.groupBy("bucket")
        .agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"))
        .where("centre <> last")
        .drop("last")
    )
    members = stored(rows.join(stored(centres, "centres"), "bucket"), "members")
    tried = stored(
        members.where("centre <> doc_id").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct(),
        "pairs",
    )
    sets = _sets_of(docs, members.select("doc_id").distinct())
    links = stored(_confirmed(tried, sets), "confirmed")
    groups = stored(components(links), "groups")
    more = stored(_remaining_links(members, groups, sets, chunk, group_docs), "remaining")
    if not more.isEmpty():
        groups = stored(components(links.unionByName(more)), "groups")
    of_class = classes.join(groups, classes["first_id"] == groups["id"], "left").select(
        "hi", "lo", F.coalesce("component", "first_id").alias("component")
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return (
        signatures.drop("bands")
        .join(stored(of_class, "classes"), ["hi", "lo"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'
  ) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
), least_of AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least_of USING (doc_id) LEFT JOIN n USING (doc_id)
"""
