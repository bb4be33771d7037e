from __future__ import annotations

import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from loglake.llm.common import table, vocabulary_path
from loglake.llm.op5_language_id import identify, train
from loglake.llm.op10_pii import replace_personal_data

from . import test_op3, test_op7

SF = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages_done_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    guesses = {r.doc_id: r for r in identify(docs, train(docs)).collect()}
    rows = [
        (r.doc_id, r.text) for r in docs.collect()
        if guesses[r.doc_id].lang_pred != "und" and guesses[r.doc_id].score >= corpus_pipeline.MIN_SCORE
    ]
    kept = {d for d, _, _, k in test_op7.brute(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, *_ in test_op3.brute(rows, items)}
    assert bad
    left = spark.createDataFrame([r for r in rows if r[0] not in bad], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = []
    for r in replace_personal_data(left).collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), ids, hashlib.sha256(r.text.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows_through_every_stage(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema], name
        docs = spark.createDataFrame(out.collect(), odd.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {3, 4, 5, 7} and sum(r.doc_id is None for r in docs.collect()) <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_empty_table_through_every_stage(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
