from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglake.llm.op11_quality_classifier import BINS, DEPTH, STATISTICS, classify, document_statistics, fit, score, statistics, train
from loglake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op11_quality_classifier"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").select("doc_id", "quality")
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    wrong = {q: sum(r.predicted != q for r in held if r.quality == q) / sum(r.quality == q for r in held) for q in (0, 1)}
    assert len(held) > 100 and wrong[0] < 0.1 and wrong[1] < 0.03


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = document_statistics(docs)
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = train(stats, labels), train(stats, turned)
    assert one.base == other.base and np.array_equal(one.leaf, other.leaf) and np.array_equal(one.threshold, other.threshold)


def test_scores_are_a_walk_down_every_tree(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = document_statistics(docs).where("doc_id < 60")
    forest = train(document_statistics(docs), labels)
    rows = {r.doc_id: np.float32(r.stats) for r in stats.collect()}
    for r in score(stats, forest).collect():
        margin = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            for _ in range(DEPTH):
                node = 2 * node + (2 if rows[r.doc_id][feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_first_split_is_the_best_one():
    """The root's split against all splits at all values."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, BINS // 2, (300, 3)).astype(np.float32)
    y = (x[:, 1] > 12).astype(int) ^ (rng.random(300) < 0.1)
    forest = fit(x, y)
    p = np.full(300, 1 / (1 + np.exp(-forest.base)))

    def gain(j: int, t: float) -> float:
        side = x[:, j] > t
        parts = [(float((p - y)[s].sum()), float((p * (1 - p))[s].sum())) for s in (side, ~side)]
        if min(h for _, h in parts) < 2:
            return 0.0
        return sum(g * g / (h + 2) for g, h in parts)

    best = max(((gain(j, t), j, t) for j in range(3) for t in np.unique(x[:, j])))
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == best[1:]
    assert ((forest.scores(x) >= 0.5) == y).mean() > 0.88


def test_statistics_do_not_mix_texts():
    texts = [b"One two two.\nOne two two.", None, b"", "été 12 !!! ABC".encode(), b" \n ", b"x" * 50_000]
    together = statistics(texts)
    assert together.shape == (6, len(STATISTICS))
    assert np.array_equal(together, np.concatenate([statistics([t]) for t in texts]))
    assert not together[[1, 2, 4]].any() and np.isfinite(together).all()
    first = dict(zip(STATISTICS, together[0].tolist()))
    assert first["log_words"] == pytest.approx(np.log(7)) and first["repeated_lines"] == 0.5 and first["capital"] == pytest.approx(2 / 6)
    other = dict(zip(STATISTICS, together[3].tolist()))
    assert other["no_letter"] == 0.5 and other["foreign"] == pytest.approx(2 / 11) and other["all_upper"] == 0.25


def test_odd_rows_and_labels(spark, odd, empty):
    marks = [(1, 1), (1, 1), (2, 0), (8, 0), (8, 1), (None, 1), (3, None), (77, 0), (9, 5)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int").withColumn("stats", F.lit("x")).withColumn("place", F.lit(1))
    got = classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert {r.score for r in classify(odd, labels.limit(0)).collect()} == {0.5}
    assert classify(empty, labels).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("if(id < 2000, 7L, id) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    stats = document_statistics(docs)
    few = train(stats, labels, max_rows=100)
    assert few.feature.shape[0] and abs(few.base) <= np.log(101)
