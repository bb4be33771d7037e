"""The stored index answers as the scan does."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loglake.operators import search as S
from loglake.operators import search_index as I
from loglake.session import new_path

WORDS = ["alpha", "beta", "gamma", "über", "x_1", "Delta", "42", "alphabet"]
ROW = "id string, message string, category string, level string, tags map<string,string>"


def _rows(n: int) -> list[tuple]:
    rng = random.Random(7)

    def text() -> str:
        return "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "-", "  ", "; "]) for _ in range(rng.randint(0, 6)))

    rows = [(f"e{i}", text(), rng.choice([None, "web", "alpha"]), rng.choice(["Error", "Fatal"]), {"k": text(), "beta": "x"} if i % 3 else None) for i in range(n)]
    return [*rows, ("none", None, None, None, None), ("empty", "", "", "Error", {})]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(_rows(150), ROW).repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, data):
    root = new_path(spark, "index")
    for part in (0, 1, 1):  # the last batch is repeated
        batch = data.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part)
        I.index_batch(batch, root, part, ["id"], I.log_fields(batch))
    return I.Index(spark, root, "id string")


QUERIES = [
    None, "  ", "alpha", "ALPHA beta", "alpha AND beta", "alpha NOT beta", "NOT alpha", "NOT (alpha OR beta) OR web", "alph*", "*ta", "?elta",
    '"alpha beta"', '"alpha beta gamma"', '"alph* b?ta"', "alpha-beta", "level:Fatal", "NOT level:Fatal", "k:alpha", "tags.k:alpha AND level:error",
    'k:"beta gamma" OR category:web', "(alpha OR (beta AND NOT gamma)) AND über", "x_1", "4*", "nothing", "* ", "-- ;", "beta:x", '"beta alpha" NOT web',
]


@pytest.mark.parametrize("query", QUERIES)
def test_index_and_scan_agree(data, index, query):
    want = sorted(r.id for r in data.filter(S.search_predicate(query)).select("id").collect())
    assert sorted(r.id for r in I.matching(index, query).collect()) == want


@pytest.mark.parametrize("terms", [["alpha"], ["alpha", "über", "42"], ["beta", "nothing"], ["nothing"]])
def test_ranking_and_scan_agree(data, index, terms):
    want = S.search_ranked(data, terms, 20, tie_break="id").select("id", "score").collect()
    assert I.ranked(index, terms, 20).collect() == want


def test_merged_segments_answer_alike(spark, data, index):
    merged = I.compact_index(index, ["0", "1"], new_path(spark, "merged"))
    for query in QUERIES[2:16]:
        assert sorted(I.matching(merged, query).collect()) == sorted(I.matching(index, query).collect())
    assert I.ranked(merged, ["alpha", "beta"]).orderBy("id").collect() == I.ranked(index, ["alpha", "beta"]).orderBy("id").collect()


def test_a_lookup_opens_its_words_partitions_only(index):
    plan = I.matching(index, "alpha AND gamma")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "message" not in plan.split("ReadSchema")[1].split("\n")[0] and "term" in plan.split("PushedFilters")[1]


def test_an_empty_batch(spark, data):
    root = new_path(spark, "index")
    I.index_batch(data.limit(0), root, 0, ["id"], I.log_fields(data))
    I.index_batch(data, root, 1, ["id"], I.log_fields(data))
    assert I.matching(I.Index(spark, root, "id string"), "alpha").count()


def _postings(rows: list[tuple[int | None, str | None]]) -> dict:
    """Word places by key and word, of all texts with that key."""
    out: dict = {}
    for key, text in rows:
        for place, word in enumerate(re.split(r"[^\w]+", (text or "").lower())):
            if word:
                out.setdefault((key, word), []).append(place)
    return {k: sorted(v) for k, v in out.items()}


def _texts(spark, rows):
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    return texts.select("id", F.lit("text").alias("field"), "text").where("text IS NOT NULL")


ONCE = [(1, "b a, a C  b"), (2, "über x_1 42"), (3, ""), (4, None), (5, " ,; "), (6, "a"), (None, "a b")]


def test_texts_are_grouped_without_a_shuffle(spark):
    found = I._text_postings(_texts(spark, ONCE).coalesce(2), ["id"])
    got = found.collect()
    assert {(r.id, r.term): r.places for r in got} == _postings(ONCE) and len(got) == len(_postings(ONCE))
    assert {(r.id, r.length) for r in got} == {(k, len(t)) for k, t in ONCE if t and re.search(r"\w", t)}
    plan = I._text_postings(spark.table(_parquet(spark, ONCE)), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def _parquet(spark, rows) -> str:
    path = new_path(spark, "texts")
    _texts(spark, rows).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("stored_texts")
    return "stored_texts"


def test_entries_that_come_more_than_once_have_one_posting(spark):
    rows = [*ONCE, (1, "a d b"), (None, "b"), (None, "b"), (7, "z"), (7, None)]
    root = new_path(spark, "index")
    I.index_batch(spark.createDataFrame(rows, "id long, text string"), root, 0, ["id"], I.text_field("text"))
    index = I.Index(spark, root, "id long")
    got = index.table("postings").collect()
    assert {(r.id, r.term): r.places for r in got} == _postings(rows) and len(got) == len(_postings(rows))
    words = {r.term: r.entries for r in index.table("dictionary").collect()}
    assert words == Counter(word for _, word in _postings(rows))
