"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglake.llm.common import literal_rows, table, vocabulary_path
from loglake.llm.op1_substring_dedup import OP1_SQL, remove_repeated_passages
from loglake.llm.op10_pii import replace_personal_data
from loglake.llm.op11_quality_classifier import classify
from loglake.llm.op12_spelling_variants import OP12_SQL, spelling_variants
from loglake.llm.op13_periodic_runs import run_digests
from loglake.llm.op2_url_filter import LISTED, OP2_SQL, RULES, judge_urls
from loglake.llm.op3_decontamination import OP3_SQL, contaminated
from loglake.llm.op4_bpe import token_digests
from loglake.llm.op5_language_id import identify, train
from loglake.llm.op6_secret_scan import OP6_SQL, scan_secrets
from loglake.llm.op7_minhash_dedup import OP7_SQL, near_duplicates
from loglake.llm.op8_lm_scoring import score_texts
from loglake.llm.op9_topk_search import OP9_SQL, top_k
from loglake.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def llm_queries():
    """(name -> callable, name -> SQL)."""
    return dict(QUERIES), dict(ORACLES)


@register("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"))


@register("op7_minhash_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op3_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


@register("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


@register("op9_topk_search", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


@register("op2_url_filter", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, RULES, ["host", "path", "verdict"])
    listed = literal_rows(spark, [(u,) for u in LISTED], ["url"])
    return judge_urls(table(spark, sf_dir, "pages"), rules, listed)


@register("op6_secret_scan", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@register("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_personal_data(docs).select("doc_id", "n_entities", "text")


@register("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@register("op11_quality_classifier")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op12_spelling_variants", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))
