"""The corpus pipeline: documents pass five stages, each a corpus operator applied to all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglake.llm.common import stored, table, vocabulary_path
from loglake.llm.op3_decontamination import contaminated
from loglake.llm.op4_bpe import encode
from loglake.llm.op5_language_id import keep_identified, train
from loglake.llm.op7_minhash_dedup import near_duplicates
from loglake.llm.op10_pii import replace_personal_data
from loglake.session import use_utc

# Documents whose language is next to a guess among the learned ones go, as do those without letters.
MIN_SCORE = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with an identified language. Null texts, and texts without a letter, go."""
    return keep_identified(docs, train(docs), MIN_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies.

    Of rows with equal doc_id one stays, by a hash of all columns; rows without a doc_id stay.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", own).join(kept, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("own"))
    one = rows.withColumn("number", F.row_number().over(first)).where("number = 1").select("own.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Rows without a doc_id stay."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; personal data is replaced, and n_chars, if there, follows the new text."""
    count = "entities of " + "_".join(docs.columns)
    out = replace_personal_data(docs, count_as=count)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(f"`{count}`") > 0, length).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every document."""
    return encode(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("bpe", bpe),
]

# Not expressible in SQL: a trained classifier, a keyed hash and an automaton. tests/llm/test_pipeline.py has the
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``; what each stage returns is written to the shared folder."""
    use_utc(spark)
    *first, (_, last) = STAGES
    docs = reduce(lambda d, s: stored(s[1](spark, d, sf_dir), s[0]), first, table(spark, sf_dir, "documents"))
    return last(spark, docs, sf_dir)


def pipeline_queries():
    """(name -> callable, name -> SQL)."""
    return {"pipeline": run}, {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
