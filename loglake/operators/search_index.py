"""A stored inverted index: which entries hold a term, how often and where.

An index is a folder of segments, one per batch. A segment has the postings (term, field, entry, places), partitioned by a
hash of the term and sorted by term, so that a lookup opens one partition and few pages of it; a dictionary (in how many
entries a term occurs); the sizes of the fields; and the keys of all entries. Writing a segment again replaces it. Searches
read postings and the small tables, never a text.

An entry's key must be in one segment only; what brings entries in (`streaming.jobs.search_branch`) sees to that.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.operators.filters import result_limit
from loglake.operators.search import _FIELDS, _split, boolean_expression, split_field
from loglake.sources.files import path_exists

BUCKETS = 16
TAG = "tags."
_WORDS = r"[^\p{L}\p{N}_]+"
# Enough for page statistics to skip most of a partition.
_ROW_GROUP = 8 << 20


def log_fields(df: DataFrame) -> Column:
    """Array of (field, text) of a log entry: its searchable columns and every tag."""
    columns = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in dict.fromkeys(_FIELDS.values()) if c in df.columns))
    tags = F.transform(
        F.map_entries("tags"), lambda e: F.struct(F.concat(F.lit(TAG), e["key"]).alias("field"), e["value"].alias("text"))
    )
    return F.concat(columns, F.coalesce(tags, F.array().cast("array<struct<field: string, text: string>>")))


def text_field(column: str) -> Column:
    return F.array(F.struct(F.lit(column).alias("field"), F.col(column).alias("text")))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _write(df: DataFrame, root: str, segment: int | str, *partitions: str) -> None:
    (
        df.withColumn("segment", F.lit(segment).cast("string"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.block.size", _ROW_GROUP)
        .partitionBy("segment", *partitions)
        .parquet(root)
    )


def _text_postings(texts: DataFrame, key: list[str]) -> DataFrame:
    """A row for each word of each text, with its places: words and places sorted as one array, cut where the word changes.

    Each step is a column of its own, read by the next; the outer form of `inline` keeps Spark from adding a filter that would
    work all of them out once more.
    """
    word = F.transform(F.split(F.lower("text"), _WORDS), lambda w, i: F.struct(w.alias("term"), i.alias("place")))
    sorted_words = F.sort_array(F.filter(word, lambda x: x["term"] != "")).alias("words")
    rows = texts.select(*key, "field", F.length("text").alias("length"), sorted_words)
    first = F.transform("words", lambda x, i: F.when((i == 0) | (x["term"] != F.get("words", i - 1)["term"]), i))
    rows = rows.select("*", F.filter(first, lambda i: i.isNotNull()).alias("firsts"))

    def posting(at: Column, k: Column) -> Column:
        n = F.coalesce(F.get("firsts", k + 1), F.size("words")) - at
        places = F.transform(F.slice("words", at + 1, n), lambda x: x["place"])
        return F.struct(F.get("words", at)["term"].alias("term"), places.alias("places"))

    found = rows.select(*key, "field", "length", F.inline_outer(F.transform("firsts", posting)))
    return found.where("term IS NOT NULL").select(*key, "field", "term", "length", "places")


def index_batch(
    df: DataFrame, root: str, segment: int | str, key: list[str], fields: Column, stored: tuple[str, ...] = ()
) -> None:
    """Write the segment of a batch: ``key`` names the columns that tell its entries apart, ``fields`` is an array of
    (field, text) structs. An entry without any text is kept as a key, and all with the columns ``stored``, from which
    hits can be shown and sorted. A repeated batch replaces its segment."""
    given = df.select(*key, fields.alias("fields"), *stored)
    texts = given.select(*key, F.inline("fields")).where("text IS NOT NULL")
    # A text is grouped by its words where it lies. Only entries that come more than once are brought together.
    again = texts.groupBy(*key, "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        postings = _text_postings(texts, key)
    else:
        same = F.expr(" AND ".join(f"t.`{c}` <=> a.`{c}`" for c in (*key, "field")))
        once, more = (texts.alias("t").join(again.alias("a"), same, how) for how in ("left_anti", "left_semi"))
        together = (
            _text_postings(more, key)
            .groupBy(*key, "field", "term")
            .agg(F.first("length").alias("length"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
        )
        postings = _text_postings(once, key).unionByName(together)
    bucket = _bucket(F.col("term")).alias("bucket")
    placed = postings.select("*", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "field")
    _write(placed, f"{root}/postings", segment, "bucket")
    columns = ", ".join(f"{c} {kind}" for c, kind in df.select(*key).dtypes)
    written = Index(df.sparkSession, root, columns).table("postings").where(F.col("segment") == str(segment))
    dictionary = written.groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("entries"))
    _write(dictionary.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), f"{root}/dictionary", segment, "bucket")
    sizes = texts.groupBy("field").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("length"))
    _write(sizes, f"{root}/sizes", segment)
    _write(given.select(*key, *stored), f"{root}/keys", segment)


def _schemas(key: str, stored: str) -> dict[str, str]:
    return {
        "postings": f"{key}, field string, term string, length int, places array<int>, segment string, bucket int",
        "dictionary": "field string, term string, entries long, segment string, bucket int",
        "sizes": "field string, texts long, length long, segment string",
        "keys": f"{key}, {stored}, segment string" if stored else f"{key}, segment string",
    }


@dataclass
class Index:
    """An index as it is stored; ``columns`` names the key's columns with their types, as in ``id string``, and ``stored``
    those kept beside it."""

    spark: SparkSession
    root: str
    columns: str
    stored: str = ""

    @property
    def key(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(",")]

    def table(self, name: str) -> DataFrame:
        schema = _schemas(self.columns, self.stored)[name]
        if not path_exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")


@dataclass
class _Word:
    """A word of a term or phrase, with its wildcards."""

    text: str

    def matches(self) -> Column:
        if not re.search(r"[*?]", self.text):
            return F.col("term") == self.text
        pattern = re.sub(r"([%_\\])", r"\\\1", self.text).replace("*", "%").replace("?", "_")
        return F.col("term").like(pattern)


def _in_fields(fields: list[str] | None, names: tuple[str, ...]) -> Column:
    """Whether a posting's field is one of ``fields``; for None, one that a plain term looks at."""
    if fields is not None:
        return F.col("field").isin(fields)
    return F.col("field").isin(*names) | F.col("field").startswith(TAG)


def _leaf_fields(piece: str) -> tuple[list[str] | None, list[str]]:
    field, rest = split_field(piece)
    if field is None:
        return None, _split(piece)
    column = _FIELDS.get(field.lower())
    return [column or TAG + field.removeprefix(TAG)], _split(rest)


def matching(index: Index, query: str | None, names: tuple[str, ...] = ("message", "category")) -> DataFrame:
    """Keys of the entries that match a query string, as `search_predicate` reads it; plain terms look at the fields
    ``names`` and at all tags. Phrases are told by the places of their words."""
    if query is None or not query.strip():
        return index.table("keys").select(*index.key)
    leaves: list[tuple[list[str] | None, list[_Word]]] = []

    def leaf(piece: str) -> str:
        fields, words = _leaf_fields(piece)
        if not any(w.strip("*") for w in words):
            return "true"  # a lone wildcard
        leaves.append((fields, [_Word(w) for w in words]))
        return f"m{len(leaves) - 1}"

    wanted = boolean_expression(query, leaf)
    if not leaves:
        return index.table("keys").select(*index.key).where(wanted)
    single = [i for i, (_, words) in enumerate(leaves) if len(words) == 1]
    phrases = [i for i in range(len(leaves)) if i not in single]
    parts = [(_in_fields(fields, names), words) for fields, words in leaves]
    every = [inside & w.matches() for inside, words in parts for w in words]
    postings = index.table("postings").where(_any(every))
    literal = [w.text for _, words in leaves for w in words if not re.search(r"[*?]", w.text)]
    if len(literal) == len(every):
        # Without wildcards only the partitions of the words are opened.
        postings = postings.where(F.col("bucket").isin(_buckets(index.spark, literal)))
    found = {f"m{i}": F.bool_or(parts[i][0] & parts[i][1][0].matches()) for i in single}
    if not phrases:
        flags = postings.groupBy(*index.key).agg(*(c.alias(n) for n, c in found.items()))
    else:
        places = {
            f"p{i}_{j}": F.flatten(F.collect_list(F.when(parts[i][0] & w.matches(), F.col("places"))))
            for i in phrases
            for j, w in enumerate(parts[i][1])
        }
        by_field = postings.groupBy(*index.key, "field").agg(*(c.alias(n) for n, c in (found | places).items()))
        phrase = {f"m{i}": F.bool_or(_adjacent([f"p{i}_{j}" for j in range(len(parts[i][1]))])) for i in phrases}
        again = {n: F.bool_or(n) for n in found}
        flags = by_field.groupBy(*index.key).agg(*(c.alias(n) for n, c in (again | phrase).items()))
    nothing = re.sub(r"\bm\d+\b", "false", wanted)
    if "NOT" in wanted and index.spark.sql(f"SELECT {nothing} AS x").first()["x"]:
        # Entries without any of the words match as well.
        flags = index.table("keys").select(*index.key).join(flags, index.key, "left")
        flags = flags.fillna(False, [f"m{i}" for i in range(len(leaves))])
    return flags.where(wanted).select(*index.key)


def hits(index: Index, query: str | None, names: tuple[str, ...] = ("message", "category")) -> DataFrame:
    """The key and the stored columns of the entries that match a query string."""
    return index.table("keys").drop("segment").join(matching(index, query, names), index.key, "left_semi")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _adjacent(names: list[str]) -> Column:
    """Whether the words of which the columns hold the places follow each other somewhere."""

    def starts(j: int) -> Column:
        return F.transform(names[j], lambda x: x - j)

    common = starts(0)
    for j in range(1, len(names)):
        common = F.array_intersect(common, starts(j))
    return F.size(common) > 0


def _buckets(spark: SparkSession, terms: list[str]) -> list[int]:
    """Partitions of some terms: literals, so Spark folds the hash without running a job."""
    hashed = spark.range(1).select(*(_bucket(F.lit(t)).alias(f"b{i}") for i, t in enumerate(terms)))
    return sorted(set(hashed.first()))


def ranked(
    index: Index, terms: list[str], k: int | None = None, field: str = "message", k1: float = 1.2, b: float = 0.75, digits: int = 9
) -> DataFrame:
    """The key and BM25 `score` of the ``k`` most relevant entries (all, for None), ties by key.

    Scores are those of `search.relevance`: text lengths in characters, average length and number of all entries. The
    statistics are one row per term, taken from the dictionary before the postings are read.
    """
    terms = [t.lower() for t in terms]
    at = _buckets(index.spark, terms)
    mine = (F.col("field") == field) & F.col("term").isin(terms)
    counts = index.table("dictionary").where(F.col("bucket").isin(at)).where(mine).groupBy("term").agg(F.sum("entries").alias("n"))
    size = index.table("sizes").where(F.col("field") == field)
    statistics = counts.select("term", "n", F.lit(None).cast("double").alias("average")).unionByName(
        size.agg(F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), (F.sum("length") / F.sum("texts")).alias("average"))
    )
    held = statistics.collect()  # one row per term, and one for the field
    average = next((r["average"] for r in held if r["term"] is None), None)
    found = {r["term"]: r["n"] for r in held if r["term"] is not None}
    total = index.table("keys").count()
    postings = index.table("postings").where(F.col("bucket").isin(at)).where(mine)
    tf = F.size("places").cast("double")
    n = F.lit(0)
    for term, entries in found.items():
        n = F.when(F.col("term") == term, F.lit(entries)).otherwise(n)
    idf = F.log(1 + (F.lit(total) - n + 0.5) / (n + 0.5))
    norm = k1 * (1 - b + b * F.col("length") / F.lit(average or 1.0))
    scored = postings.groupBy(*index.key).agg(F.round(F.sum(idf * tf * (k1 + 1) / (tf + norm)), digits).alias("score"))
    return scored if k is None else scored.orderBy(F.col("score").desc(), *index.key).limit(result_limit(k))


def compact_index(index: Index, segments: list[str], into: str) -> Index:
    """Merge segments to one, in a new folder; searches over it give the same answers."""
    for name, partitions in (("postings", ["bucket"]), ("sizes", []), ("keys", [])):
        rows = index.table(name).where(F.col("segment").isin(segments)).drop("segment")
        if partitions:
            rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "field")
        if name == "sizes":
            rows = rows.groupBy("field").agg(F.sum("texts").alias("texts"), F.sum("length").alias("length"))
        _write(rows, f"{into}/{name}", "merged", *partitions)
    merged = index.table("dictionary").where(F.col("segment").isin(segments)).groupBy("bucket", "field", "term").agg(F.sum("entries").alias("entries"))
    _write(merged.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), f"{into}/dictionary", "merged", "bucket")
    return Index(index.spark, into, index.columns, index.stored)
