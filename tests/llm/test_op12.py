from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from loglake.llm.op12_spelling_variants import blocks, near_words, spelling_variants
from loglake.llm.queries import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(u: str, v: str) -> bool:
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    short, long = sorted((u, v), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 5 and n >= 3})


def brute_near(words: Counter) -> dict[str, list[str]]:
    """All near words, by the strings with a hole and by those with a letter less."""
    holes, out = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes.setdefault(w[:i] + "_" + w[i + 1 :], set()).add(w)
            less = w[:i] + w[i + 1 :]
            if less in words:
                out[w].add(less)
                out[less].add(w)
    for group in holes.values():
        for w in group:
            out[w] |= group - {w}
    return out


def brute_rows(words: Counter) -> list[tuple]:
    near = brute_near(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def rows_of(df) -> list[tuple]:
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_brute_force(spark, sf):
    got = QUERIES["op12_spelling_variants"](spark, f"/root/testdata/sf{sf}")
    assert got.columns == COLUMNS
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_rows(brute_words(docs))
    assert rows_of(got) == want
    assert any(form for _, form, *_ in want) and any(root != form for _, form, root, *_ in want if form)


def random_counts(rng: random.Random) -> Counter:
    """Words close to each other: few letters, many lengths, and a few very long ones."""
    out = Counter()
    for _ in range(600):
        w = "".join(rng.choices("abé", k=rng.randint(5, 8)))
        out[w] = rng.randint(3, 60)
    for w in rng.choices(sorted(out), k=100):
        out[w + "x" * 1200] = rng.randint(3, 60)
        out[w + "x" * 1201] = rng.randint(3, 60)
    return out


@pytest.mark.parametrize("max_block", [2, 16, 2048])
def test_blocks_of_any_size_lose_no_pair(spark, max_block):
    words = random_counts(random.Random(max_block))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in near_words(df, max_block).collect()}
    every, want = brute_near(words), {}
    for w, near in every.items():
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want[w] = (len(near), words[best], best)
    assert got == want
    some = sorted(words)[:60]
    assert all((v in every[u]) == one_edit(u, v) for u in some for v in some)


def test_a_hot_block_is_divided(spark):
    """All words share their first twelve letters."""
    rng = random.Random(9)
    words = {"abcdefghijkl" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    sizes = blocks(df, 64).groupBy("m", "low", "high", "h").count().where("count > 64")
    assert not sizes.where("high - low > 1").count()


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    extra = [(None, "Straße strasse STRASSE strasze " * 3), (5, "ÉCOLE école École écol " * 4), (7, "a" * 30_000 + " "), (7, "×÷×÷×÷ " * 3)]
    docs = odd.unionByName(spark.createDataFrame([(*e, None, None, None) for e in extra], odd.schema))
    assert rows_of(spelling_variants(docs)) == brute_rows(brute_words(rows + extra))
    assert spelling_variants(empty).count() == 0
