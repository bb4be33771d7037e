from __future__ import annotations

import numpy as np

from loglake.llm.op5_language_id import FEATURE_BITS, SCALE, _ngrams, _sample, fit_ftrl, fit_temperature, identify, train

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    rows = identify(docs, train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_is_the_model_applied_to_whole_texts(spark):
    """The vectorised prediction against a plain sum over all n-grams."""
    docs = spark.read.parquet(DATA).where("doc_id < 40")
    model = train(spark.read.parquet(DATA))
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    for row in docs.collect():
        features = np.concatenate([f for _, f in _ngrams([row.text.encode()], (1, 2, 3))])
        z = model.weights[:, features].sum(axis=1, dtype=np.float64) / len(features)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[row.doc_id].lang_pred == model.langs[int(p.argmax())]
        assert abs(got[row.doc_id].score - p.max()) < 1e-6


def test_ngrams_do_not_cross_texts():
    together = [(d, f) for doc, feature in _ngrams([b"ab", b"", b"cde"], (1, 2, 3)) for d, f in zip(doc, feature)]
    alone = [(i, f) for i, t in enumerate([b"ab", b"", b"cde"]) for _, feature in _ngrams([t], (1, 2, 3)) for f in feature]
    assert sorted(together) == sorted(alone) and len(together) == 9


def test_odd_rows(spark, odd):
    model = train(spark.read.parquet(DATA))
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score, r.held_out) for r in identify(odd, model).collect()), key=str)
    assert len(got) == odd.count()
    by_id = {d: (lang, score) for d, lang, score, _ in got}
    for nothing in (3, 4, 5):
        assert by_id[nothing] == ("und", 0.0)
    assert [h for d, _, _, h in got if d == 0] == [True]


def test_nothing_to_learn(odd, empty):
    assert train(empty) is None
    assert identify(empty, None).count() == 0
    assert {r.lang_pred for r in identify(odd, None).collect()} == {"und"}


def test_sparse_weights_and_temperature():
    rng = np.random.default_rng(0)
    vectors = []
    for i in range(300):
        label = i % 2
        features = np.array([label, 2 + int(rng.integers(50))])
        vectors.append((features, np.full(2, SCALE / 10, np.float32), label))
    w = fit_ftrl(vectors, 2)
    assert w.shape == (1 << FEATURE_BITS, 2) and np.count_nonzero(w.any(axis=1)) <= 52
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    noisy = [(f, x, int(rng.random() < 0.3) ^ label) for f, x, label in vectors]
    assert fit_temperature(noisy, w) > fit_temperature(vectors, w)


def test_long_texts_and_rare_languages_are_learned(spark):
    """Of one language all texts are very long, of another there are two among thousands."""
    rng = np.random.default_rng(5)

    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))

    rows = [(i, text("abcdef", 12), "aa") for i in range(4000)]
    rows += [(10_000 + i, text("ghijkl", 3000), "bb") for i in range(30)]
    rows += [(20_000 + i, text("mnopqr", 12), "cc") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {d: lang for d, _, lang in rows}
    got = {r.doc_id: r.lang_pred for r in identify(docs, train(docs)).collect()}
    assert got == want
    assert train(docs.where("lang = 'bb'")).langs == ["bb"]


def test_copies_of_a_row_are_one_text(spark):
    """Thousands of equal rows neither fill the sample nor crowd the other texts out."""
    docs = spark.range(6000).selectExpr("if(id < 5900, 7L, id) AS doc_id", "if(id < 5900, 'same', concat('text ', id)) AS text", "'en' AS lang")
    rows = docs.selectExpr("lang", "pmod(xxhash64(doc_id, text), 1L << 62) AS place")
    assert _sample(rows, 50).count() == 50
    assert _sample(rows, 500).count() == 101
