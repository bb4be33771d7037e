from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from loglake.llm.op13_periodic_runs import Extensions, collapse_runs, find_runs, lyndon_lengths, run_digests
from loglake.llm.queries import QUERIES
from loglake.llm.words import split_words

NOTHING = hashlib.sha256(b"").hexdigest()


def brute_runs(words: list[str]) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    number = np.unique(words, return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([False], number[:-q] == number[q:], [False]))
        turns = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist()):
            length, x = j - i + q, number[i : j + q]
            if length >= max(6, 4 * q) and not any((x[:-p] == x[p:]).all() for p in range(1, q)):
                out.append((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs) -> str:
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def expected(doc_id, text) -> tuple:
    """The contract, word by word."""
    words = [w.decode() for w in (text or "").encode().split()] if text else []
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapse(words, runs).encode()).hexdigest(),
    )


def random_words(rng: random.Random) -> list[str]:
    letters = "abcde"[: rng.choice([2, 3, 5])]
    out = rng.choices(letters, k=rng.randint(0, 10))
    for _ in range(rng.randint(0, 3)):
        out += (rng.choices(letters, k=rng.randint(1, 5)) * 7)[: rng.randint(0, 30)]
    return out + rng.choices(letters, k=rng.randint(0, 4))


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(200):
        s = rng.choices(range(rng.choice([1, 2, 3, 5])), k=rng.randint(1, 25))
        ends = [[b for b in range(a + 1, len(s) + 1) if all(s[a:b] < s[k:b] for k in range(a + 1, b))] for a in range(len(s))]
        assert lyndon_lengths(np.array(s)).tolist() == [e[-1] - a for a, e in enumerate(ends)]


def test_extensions():
    rng = np.random.default_rng(2)
    s = np.concatenate(([-1], rng.integers(0, 2, 200), np.zeros(100, int), [-2]))
    lce = Extensions(s, len(s))
    a = rng.integers(0, 300, 500)
    b = a + 1 + rng.integers(0, 301 - a)
    for i, j, n, m in zip(a, b, lce.forward(a, b), lce.backward(a, b)):
        assert n == next((k for k in range(len(s) - j) if s[i + k] != s[j + k]), len(s) - j)
        assert m == next((k for k in range(i + 1) if s[i - k] != s[j - k]), i + 1)


def test_runs_of_several_texts():
    rng = random.Random(3)
    for _ in range(200):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        w = split_words([" ".join(t).encode() for t in texts])
        r = find_runs(w, np.arange(len(w.start)))
        got = list(zip(r.doc.tolist(), r.start.tolist(), r.length.tolist(), r.period.tolist()))
        assert got == [(d, *run) for d, t in enumerate(texts) for run in brute_runs(t)]


def test_query_against_brute_force(spark):
    got = QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(map(tuple, got)) == sorted(expected(r.doc_id, r.text) for r in docs)
    assert any(r.n_runs for r in got)


def test_odd_rows(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    got = run_digests(odd).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(r.doc_id, r.text)) for r in rows)
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert (r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) == (0, None, NOTHING, NOTHING)
    assert run_digests(empty).count() == 0 and collapse_runs(empty).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so " + "very " * 8 + "good"), (2, "a b a b a b a c"), (None, "x " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in collapse_runs(docs).collect()}
    assert got[1] == ("so very good", [(1, 8, 1)])
    assert got[2] == ("a b a b a b a c", [])
    assert got[None] == ("x", [(0, 100_000, 1)])
