from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from loglake.llm.components import components
from loglake.llm.op7_minhash_dedup import _split_blocks, band_keys, near_duplicates


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """All pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(
        ((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str
    )


def result(df, **options):
    return sorted(map(tuple, near_duplicates(df, **options).collect()), key=str)


def test_odd_rows(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_empty_table(empty):
    assert result(empty) == []


def test_documents(some_docs):
    assert result(some_docs) == brute([(r.doc_id, r.text) for r in some_docs.collect()])


def test_chains_and_crowds(spark):
    """Copies of one text with more and more changes: many pairs just above and just below the limit."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 6])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i * 7 % 151, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({r[2] for r in want}) > 3
    assert result(df) == want
    assert result(df, chunk=2000) == want


def test_short_texts_with_a_common_opening(spark):
    """Many documents under one minimum that are not alike: divided into small groups, without a lost link."""
    rng = random.Random(3)
    sets = [[1, 2, 3, *rng.sample(range(100, 100_000), 6)] for _ in range(300)]
    sets += [[*s[:8], 7] for s in sets[:40]] + [list(range(10**6, 10**6 + n)) for n in (100, 120, 128, 129, 150)]
    rows = [(5, i, i, len(s), np.array(s, "<i8").tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "block long, doc_id long, component long, n long, own binary")
    blocks = defaultdict(set)
    for r in _split_blocks(df, 20).collect():
        blocks[r.block].add(r.doc_id)
    assert max(map(len, blocks.values())) <= 20
    alike = [
        (i, j) for i, s in enumerate(sets) for j, t in enumerate(sets[:i])
        if 100 * len(set(s) & set(t)) >= 75 * len(set(s) | set(t))
    ]
    assert len(alike) > 40
    assert all(any({i, j} <= b for b in blocks.values()) for i, j in alike)
    assert _split_blocks(df, 1000).count() == len(sets)


def test_groups_are_bounded_by_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["a b c d e f", *(f"w{rng.randrange(12)}" for _ in range(4))])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, group_docs=7) == brute(rows)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 100, 100))
    hits = [
        (band_keys(np.concatenate((x, a, x, b)), np.array([0, 700, 1400]))[[0, 1]])
        for x in (shared,)
    ]
    # 600 of 800 shared: a band of five values agrees with probability 0.75 ** 5.
    share = np.mean([(k[0] == k[1]).mean() for k in hits])
    assert 0.05 < share < 0.45


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    graph = defaultdict(set)
    for a, b in edges:
        graph[a].add(b)
        graph[b].add(a)
    want = {}
    for start in sorted(graph):
        if start not in want:
            stack = [start]
            while stack:
                x = stack.pop()
                if x not in want:
                    want[x] = start
                    stack += graph[x]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    alone = {a for a in graph if graph[a] == {a}}
    assert {r.id: r.component for r in got} == {k: v for k, v in want.items() if k not in alone}
    assert len(got) == len(want) - len(alone)
