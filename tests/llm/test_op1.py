from __future__ import annotations

import hashlib
import re
from collections import Counter

from loglake.llm.op1_substring_dedup import remove_repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    last = float("inf")
    docs = [(last if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, words in docs:
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            first[key] = min(first.get(key, last), d)
    out = []
    for (d, words), (doc_id, _) in zip(docs, rows):
        gone = set()
        for i in range(len(words) - size + 1):
            if first[tuple(words[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def result(df, **options):
    return Counter(map(tuple, remove_repeated_passages(df, **options).collect()))


def test_odd_rows(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_empty_table(empty):
    assert result(empty) == Counter()


def test_documents(some_docs):
    assert result(some_docs) == brute([(r.doc_id, r.text) for r in some_docs.collect()])


def test_tiny_sketch_only_passes_more(some_docs):
    """With every cell shared by thousands of windows the result stays the same."""
    assert result(some_docs, max_row_bits=6, shard_bits=4) == brute([(r.doc_id, r.text) for r in some_docs.collect()])
