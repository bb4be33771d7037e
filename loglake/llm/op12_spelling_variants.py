"""Spelling variants: words that differ in one letter, grouped under their most frequent form.

Words are counted over all documents. Two words are near if one inserted, deleted or replaced letter turns one into the
other. Their vectors of letter counts then have a squared distance of one or two, so near words are sought in blocks by
Gram matrices: products of the blocks' count vectors give all distances at once, pairs of the same length at two and
of adjacent lengths at one are kept, and their edits are verified on the letters.

A block holds the words of two adjacent lengths that agree outside one piece of the word. An edit touches one piece only,
so no pair is lost, and of the blocks that two words share only the one with the place of their first difference counts the
pair. Blocks with many words are divided again by parts of that piece, down to a piece of one letter, which bounds a block by the
alphabet. A block gives, for each of its words, the number of near words and the best of them, never all pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import stored

MIN_LETTERS = 5
MIN_COUNT = 3
DAMAGED = 97
PIECES = 3
MAX_BLOCK = 2048
LETTERS = 26 + 64
HELD_WORDS = 1 << 18
RUN = re.compile("[A-Za-zÀ-ÿ]+")

COUNT_SCHEMA = "word string, n long"
NEAR_SCHEMA = "word string, n_near long, best_n long, best string"


def words_of(doc_id: int | None, text: bytes | None) -> Iterator[tuple[str, int]]:
    """(word, times) of one text: runs of letters with A-Z lower-cased, one in 97 of them, by a hash of id and run, with
    a letter missing. A null id counts as an empty one."""
    if not text:
        return
    state = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, times in Counter(RUN.findall(text.lower().decode())).items():
        if len(word) >= MIN_LETTERS:
            h = zlib.crc32(word.encode(), state)
            if h % DAMAGED == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= MIN_LETTERS:
                yield word, times


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for rows in batches:
        for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].cast(pa.binary())):
            for word, times in words_of(doc_id, text.as_py()):
                held[word] += times
            if len(held) > HELD_WORDS:
                yield batch()
                held.clear()
    yield batch()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of the words of ``MIN_LETTERS`` letters and ``MIN_COUNT`` occurrences or more, in all documents."""
    counts = docs.select("doc_id", "text").mapInArrow(_counts, COUNT_SCHEMA)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


BLOCK = ["m", "low", "high", "h"]


def _divided(words: DataFrame) -> DataFrame:
    """Every row once per part of its piece, which goes from ``low`` to ``high`` in words of ``m`` letters or one more; ``h``
    is a hash of the letters outside the part."""
    m, low, high = F.col("m"), F.col("low"), F.col("high")
    parts = F.least(high - low, F.lit(PIECES))

    def cut(j: Column) -> Column:
        return (low + F.floor((high - low) * j / parts)).cast("int")

    cuts = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(cut(j).alias("a"), cut(j + 1).alias("b")))
    found = words.select("word", "n", "m", F.explode(cuts).alias("cut"))
    a, b = F.col("cut.a"), F.col("cut.b")
    before = F.substring("word", F.lit(1), a)
    after = F.substring("word", F.length("word") - m + b + 1, m - b)
    return found.select("m", a.alias("low"), b.alias("high"), F.xxhash64(before, after).alias("h"), "word", "n")


def blocks(words: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """m, low, high, h, word, n: every word with its blocks; none has more than ``max_block`` words, unless its piece is a
    single letter."""
    length = F.length("word")
    both = F.filter(F.array(length, length - 1), lambda m: m >= MIN_LETTERS)
    start = words.select("word", "n", F.explode(both).alias("m"))
    now = stored(_divided(start.withColumn("low", F.lit(0)).withColumn("high", F.col("m"))), "blocks")
    done = []
    while True:
        hot = stored(now.groupBy(BLOCK).count().where((F.col("count") > max_block) & (F.col("high") - F.col("low") > 1)).select(BLOCK), "hot")
        if hot.isEmpty():
            break
        done.append(now.join(hot, BLOCK, "left_anti"))
        now = stored(_divided(now.join(hot, BLOCK, "left_semi")), "blocks")
    for part in done:
        now = now.unionByName(part)
    return now


def _first_difference(flat: np.ndarray, a: np.ndarray, b: np.ndarray, m: int, longer: bool) -> np.ndarray:
    """Place of the one edit between the words of ``m`` letters at ``a`` and those at ``b``, of m + 1 if ``longer``;
    -1 if there is not exactly one."""
    letters = np.arange(m)
    one = flat[a[:, None] + letters]
    same = one == flat[b[:, None] + letters]
    place = np.where(same.all(axis=1), m, same.argmin(axis=1))
    shifted = one == flat[b[:, None] + letters + 1] if longer else same
    rest = letters >= place[:, None] + (0 if longer else 1)
    return np.where((shifted | ~rest).all(axis=1), place, -1)


def _near(batch: pa.Table) -> pa.RecordBatch:
    """word, n_near, best_n, best of the words of some whole blocks, sorted by block and word."""
    words, n = batch["word"].to_pylist(), batch["n"].to_numpy()
    m, low, high, h = (batch[c].to_numpy() for c in BLOCK)
    size = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    flat = np.append(np.where(codes < 128, codes - 97, codes - 0xC0 + 26), LETTERS).astype(np.uint8)
    start = np.cumsum(size) - size
    new = np.ones(len(words), bool)
    new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(words)))
    kind = np.float32 if size.max() < 1000 else np.float64  # distances are exact in either
    near_a, near_b = [], []
    # Blocks of a like size are multiplied together.
    widths = 1 << np.ceil(np.log2(np.maximum(count, 1))).astype(int)
    for width in np.unique(widths[count > 1]).tolist():
        own = np.flatnonzero((widths == width) & (count > 1))
        step = max(1, (1 << 21) // (width * (LETTERS + width)))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            slots = first[part][:, None] + np.arange(width)
            filled = np.arange(width) < count[part][:, None]
            rows = slots[filled]
            vectors = np.zeros((len(part) * width, LETTERS), kind)
            target = np.repeat(np.flatnonzero(filled.ravel()), size[rows])
            inside = np.arange(len(target)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
            cell = target * LETTERS + flat[np.repeat(start[rows], size[rows]) + inside]
            vectors += np.bincount(cell, minlength=vectors.size).reshape(vectors.shape)
            vectors = vectors.reshape(len(part), width, LETTERS)
            square = (vectors**2).sum(axis=2)
            distance = square[:, :, None] + square[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))
            extra = np.where(filled, size[np.minimum(slots, len(size) - 1)] - m[first[part]][:, None], -1)
            # Shorter word first; of two equally long ones the earlier.
            wanted = (extra[:, :, None] == 0) & (extra[:, None, :] >= 0) & (distance == 2 - extra[:, None, :])
            wanted &= (extra[:, None, :] == 1) | (np.arange(width)[:, None] < np.arange(width))
            block, i, j = np.nonzero(wanted)
            near_a.append(slots[block, i])
            near_b.append(slots[block, j])
    a, b = np.concatenate(near_a or [first[:0]]), np.concatenate(near_b or [first[:0]])
    keep = np.zeros(len(a), bool)
    groups = m[a] * 2 + (size[b] - m[b])
    for group in np.unique(groups).tolist():
        letters, longer = int(group // 2), bool(group % 2)
        pairs = np.flatnonzero(groups == group)
        step = max(1, (1 << 21) // letters)
        for at in range(0, len(pairs), step):
            p = pairs[at : at + step]
            place = _first_difference(flat, start[a[p]], start[b[p]], letters, longer)
            # The pair counts in the block whose piece has the place; behind the last letter, in that of the last piece.
            inside = np.minimum(place, letters - 1)
            keep[p] = (place >= 0) & (low[a[p]] <= inside) & (inside < high[a[p]])
    a, b = np.concatenate((a[keep], b[keep])), np.concatenate((b[keep], a[keep]))
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    head = np.ones(len(a), bool)
    head[1:] = a[1:] != a[:-1]
    at = np.flatnonzero(head)
    best, own = b[at], a[at]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in own.tolist()], pa.string()), pa.array(np.diff(np.append(at, len(a))), pa.int64()),
            pa.array(n[best], pa.int64()), pa.array([words[i] for i in best.tolist()], pa.string()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def _near_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows come sorted by block and word; a block may go on in the next batch."""
    held = None
    for rows in batches:
        if not rows.num_rows:
            continue
        table = pa.Table.from_batches([rows])
        held = pa.concat_tables([held, table]) if held is not None else table
        keys = [held[c].to_numpy() for c in BLOCK]
        same = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield _near(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
    if held is not None:
        yield _near(held.combine_chunks())


def near_words(words: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """word, n_near, best (n, word): the number of near words and the most frequent one, the smallest among equals; words
    without any are left out."""
    dealt = blocks(words, max_block).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "word")
    # Of rows with equal n the smallest word wins.
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("first")
    found = dealt.mapInArrow(_near_blocks, NEAR_SCHEMA).groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return found.select("word", "n_near", (-F.col("first.minus")).alias("best_n"), F.col("first.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for every word with a form. A form is at least twice as frequent as its word, so chains are short, and every
    round doubles the steps taken."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = roots.join(further, "root", "left")
        roots = stored(ahead.select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            return roots.drop("moved")
        roots = roots.drop("moved")


def spelling_variants(docs: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every counted word of ``docs`` (doc_id, text; others ignored).

    ``form`` is the most frequent near word, the smallest among equals, if at least twice as frequent as the word, else null;
    ``root`` is where the forms lead. Null and empty texts have no words; repeated rows count each time; without words the
    result is empty.
    """
    words = stored(count_words(docs), "words")
    near = near_words(words, max_block)
    kept = F.col("best_n") >= 2 * F.col("n")
    found = stored(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(kept, F.col("best")).alias("form"), F.when(kept, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc_table() -> list[int]:
    """The table of the reversed polynomial 0xEDB88320, a byte at a time."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
        out.append(byte)
    return out


OP12_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+') AS r FROM documents),
every AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(r) AS w FROM runs) WHERE length(w) >= {MIN_LETTERS} GROUP BY ALL),
begun AS (SELECT doc_id, list_reduce(list_transform(range(1, length(p) + 1), lambda i: ord(p[i])),
    lambda s, b: xor(s >> 8, {_crc_table()}[(xor(s, b) & 255) + 1]), 4294967295::BIGINT) AS s
  FROM (SELECT DISTINCT doc_id, concat(doc_id, ':') AS p FROM documents)),
hashed AS (SELECT w, c, xor(4294967295::BIGINT, list_reduce(flatten(list_transform(range(1, length(w) + 1),
    lambda i: CASE WHEN ord(w[i]) < 128 THEN [ord(w[i])] ELSE [195, ord(w[i]) - 64] END)),
    lambda s, b: xor(s >> 8, {_crc_table()}[(xor(s, b) & 255) + 1]), begun.s)) AS h
  FROM every JOIN begun ON every.doc_id IS NOT DISTINCT FROM begun.doc_id),
damaged AS (SELECT c, CASE WHEN h % {DAMAGED} = 0 THEN concat(substr(w, 1, (h % length(w))::BIGINT), substr(w, (h % length(w))::BIGINT + 2)) ELSE w END AS word FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM damaged WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT DISTINCT word, n, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS x FROM places),
holes AS (SELECT word, n, i, concat(substr(word, 1, i - 1), '_', substr(word, i + 1)) AS x FROM places),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.x = b.x AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.x = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.x = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM pairs GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN other END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS spot, 0 AS k FROM forms
  UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.spot WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(spot, k) FROM steps s WHERE s.word = f.word) AS root, n, n_near::BIGINT AS n_near, form_n FROM forms f"""
