from __future__ import annotations

from loglake.llm.op3_decontamination import contaminated, sketch_length

from .conftest import passage


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    sets, parts = {}, {}
    for target, rows in ((sets, docs), (parts, items)):
        for i, t in rows:
            if i is not None:
                target.setdefault(i, set()).update(shingles(t))
    return {
        (d, i, len(s & p), len(p)) for d, s in sets.items() for i, p in parts.items() if p and 4 * len(s & p) >= 3 * len(p)
    }


def result(docs, items):
    return {tuple(r)[:4] for r in contaminated(docs, items).collect()}


def test_odd_rows(spark, odd):
    items = [
        (1, passage(20, 5), "a"), (2, "ONE two", "a"), (3, None, "a"), (4, "", "a"), (5, passage(19, 5) + " other words are here now", "a"),
        (6, passage(20, 5), "b"), (None, passage(20), "c"), (7, "word1", "d"), (8, passage(10) + " cut " + passage(10, 10), None),
    ]
    table = spark.createDataFrame(items, "item_id long, text string, shingle string")
    assert result(odd, table) == brute([(r.doc_id, r.text) for r in odd.collect()], [i[:2] for i in items])


def test_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, passage(20))], "item_id long, text string")
    assert result(empty, items) == set()
    assert result(odd, items.limit(0)) == set()


def test_documents(spark, some_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in some_docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and result(some_docs, items) == want


def test_sketch_cannot_miss():
    """75 % of the shingles always leave fewer than a sketch outside."""
    for n in range(1, 2000):
        assert sketch_length(n) > n - -(-75 * n // 100) or sketch_length(n) == n
