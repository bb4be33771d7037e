from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

from loglake.llm.op8_lm_scoring import (
    DIMENSIONS, GROUPS, LEAF_NOISE, NOISE, RATE, Block, Statistics, Tokens, _log_sums, _sum_rows, _tokens, adagrad, initial,
    leaf_shape, log_probabilities, nce_epoch, score_texts, word_shares,
)
from loglake.llm.words import split_words, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [w.encode().lower() for w in WORD.findall(text or "")] + [None]


def check_base(df, **options):
    """Everything but the model's score, from plain counts."""
    rows = [(r.doc_id, tokens(r.text)) for r in df.collect()]
    held = [d is None or zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter(
        (d, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5))
        for (d, t), h in zip(rows, held)
    )
    got = score_texts(df, **options).collect()
    assert Counter((*r[:5], round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


def test_odd_rows(odd):
    check_base(odd)
    check_base(odd, top_words=3, part_bytes=500)


def test_empty_table(empty):
    assert score_texts(empty).count() == 0


def test_nothing_to_learn(spark):
    assert score_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().train_tokens == 0


def test_documents_beat_the_base_model(spark):
    got = check_base(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def statistics(n, groups=3, size=4):
    leaves = np.arange(groups * size).reshape(groups, size) + 1
    return Statistics(
        1000, n + 2, 50, np.arange(n, dtype=np.uint64), np.zeros(n, np.uint64), np.arange(n)[::-1] + 1, leaves, leaves // 2, 40
    )


def all_tokens(stats):
    """Every token that can follow, by class and leaf."""
    groups, size = stats.leaf_tokens.shape
    classes = [*range(1, stats.first_group), *np.repeat(np.arange(groups) + stats.first_group, size)]
    leaves = [*[-1] * (stats.first_group - 1), *np.tile(np.arange(size), groups)]
    return np.array(classes), np.array(leaves)


def test_probabilities_add_up_to_one():
    """Over classes and leaves after any context, and over the words of a leaf with the place for unknown ones."""
    stats = statistics(20)
    p = initial(stats)
    classes, leaves = all_tokens(stats)
    rng = np.random.default_rng(3)
    for _ in range(50):
        rows = rng.integers(0, len(p[0]), (4, 1)).repeat(len(classes), axis=1)
        tokens = Tokens(classes, leaves, rows[:2], rows[2:], classes)
        assert abs(np.exp(log_probabilities(p, stats, tokens)).sum() - 1) < 1e-4
    at = np.flatnonzero((classes == stats.first_group + 1) & (leaves == 3))  # 8 tokens, 4 words
    one = Tokens(classes[at].repeat(5), leaves[at].repeat(5), rows[:2, :5], rows[2:, :5], at)
    assert abs(np.exp(word_shares(stats, one, np.array([3, 2, 2, 1, 0]))).sum() - 1) < 1e-9


def test_training_learns_a_pattern():
    """A sequence whose next token follows from the last one, among frequent words and among leaves."""
    stats = statistics(5)
    n = stats.first_group
    classes = np.tile([2, n, 3, n + 1, 4, n, 5, n + 2], 2000)
    leaves = np.tile([-1, 0, -1, 3, -1, 2, -1, 1], 2000)
    rows = np.stack([np.tile(np.arange(8) + n + 1, 2000), np.tile(np.arange(8) + n + 11, 2000)])
    tokens = Tokens(classes, leaves, np.roll(rows, 1, axis=1), np.roll(rows, 2, axis=1), classes)
    p = initial(stats)
    sums, before = adagrad(p), log_probabilities(p, stats, tokens).mean()
    assert p[0].shape == (n + 41, DIMENSIONS)
    for _ in range(20):
        nce_epoch(p, sums, stats, tokens, np.random.default_rng(0))
    assert before < -2 and log_probabilities(p, stats, tokens).mean() > -0.5


def test_every_word_counts_where_it_stands(spark):
    """Two texts that differ in the order of two rare words have different scores."""
    rows = [(i, f"the cat sat rare{i} on the mat" if i % 7 else "the dog ran") for i in range(400)]
    swapped = [(1000, "the rare1 cat rare2 sat"), (1001, "the rare2 cat rare1 sat")]
    df = spark.createDataFrame(rows + swapped, "doc_id long, text string")
    got = {r.doc_id: r for r in check_base(df, top_words=4)}
    assert abs(got[1000].base_score - got[1001].base_score) < 1e-9
    assert abs(got[1000].score - got[1001].score) > 1e-6


def plain_score(p, stats, words, counts):
    """Log10 probability of a text, token by token, with sums over every class, leaf and word place."""
    total, before = 0.0, [tuple(stats.start)] * 2
    for w in [*words, None]:
        place = stats.places(*key(w))[:, 0] if w else stats.end
        q = sum(p[k][row].astype(float) for k in (0, 1) for row in before[k])
        z = [float(q @ p[2][c] + p[3][c]) for c in range(stats.n_classes)]
        total += math.log10(math.exp(z[place[0]]) / sum(math.exp(x) for x in z[1:]))
        if place[1] >= 0:
            g = place[0] - stats.first_group
            z = [float(q @ p[4][g, k] + p[5][g, k]) for k in range(stats.leaf_tokens.shape[1])]
            total += math.log10(math.exp(z[place[1]]) / sum(math.exp(x) for x in z))
            tokens, known = stats.leaf_tokens[g, place[1]], stats.leaf_words[g, place[1]]
            total += math.log10((counts[w] + 0.5) / (tokens + 0.5 * (known + 1)))
        before = [tuple(place[2:]), before[0]]
    return total


def key(word):
    w = split_words([word])
    return word_hashes(w), word_hashes(w, 1) >> np.uint64(32)


def test_scores_of_a_block_against_plain_sums():
    texts = [b"a b c a", b"", b"b x y z a", b"q"]
    words = split_words(texts)
    block = Block(0, np.arange(4), np.zeros(4, bool), np.zeros(4, bool), words)
    hi, lo, of = block.distinct()
    stats = statistics(0)
    top = sorted(zip(*(x.tolist() for x in np.concatenate([np.array(key(w)) for w in (b"a", b"b")], axis=1))))
    stats.top_hi, stats.top_lo = (np.array(x, np.uint64) for x in zip(*top))
    stats.top_counts = np.array([4, 3])
    p = initial(stats)
    for x in p:
        x *= 3
    counts = {w: i % 3 for i, w in enumerate(sorted({w for t in texts for w in t.split()}))}
    tokens = _tokens(block, stats, stats.places(hi, lo), of)
    of_token = np.array([counts.get(w, 0) for t in texts for w in [*t.split(), b""]])
    log_p = (log_probabilities(p, stats, tokens) + word_shares(stats, tokens, of_token)) / math.log(10)
    got = np.bincount(tokens.doc, log_p)
    assert np.allclose(got, [plain_score(p, stats, t.split(), counts) for t in texts], atol=1e-4)


def test_work_for_a_token_grows_slower_than_the_leaves():
    """All leaves stay, and a token is compared with few more groups and leaves in 60 times the text."""
    for n_bytes in (0, 1, 10**4, 25 * 10**6, 864 * 10**6, 50 * 10**9):
        groups, leaves = leaf_shape(n_bytes)
        assert groups >= GROUPS and groups * leaves * 2 >= math.isqrt(n_bytes)
        assert groups * leaves <= math.isqrt(n_bytes) // 2 + 2 * groups
    small, large = sum(leaf_shape(864 * 10**6)), sum(leaf_shape(50 * 10**9))
    assert large <= 3 * small and large <= 700


def test_sums_of_rows():
    rng = np.random.default_rng(5)
    for n in (1, 7, 500):
        rows, gradient = rng.integers(0, 60, n), rng.normal(size=(n, 3)).astype(np.float32)
        want = np.zeros((60, 3))
        np.add.at(want, rows, gradient)
        at, got = _sum_rows(rows, gradient)
        assert at.tolist() == sorted(set(rows.tolist())) and np.allclose(got, want[at], atol=1e-5)


def test_normalising_sums_of_any_size():
    """Also where the products or the biases are too large for exp."""
    rng = np.random.default_rng(6)
    q, targets = rng.normal(size=(2000, DIMENSIONS)), rng.normal(size=(70, DIMENSIONS))
    for scale, bias in ((1, 1), (0, 0), (100, 1), (1, 500), (1, -500), (100, -500)):
        x, y = (scale * q).astype(np.float32), targets.astype(np.float32)
        b = (rng.normal(size=70) + bias).astype(np.float32)
        z = x.astype(float) @ y.T.astype(float) + b
        top = z.max(axis=1)
        assert np.allclose(_log_sums(x, y, b), np.log(np.exp(z - top[:, None]).sum(axis=1)) + top, rtol=1e-4, atol=1e-3)


def plain_batch(p, sums, stats, tokens, rng):
    """A batch of noise-contrastive estimation, token by token."""
    n, size = len(tokens.classes), stats.leaf_tokens.shape[1]
    noise, leaf_noise = stats.noise(), stats.leaf_noise()
    drawn = rng.choice(len(noise), NOISE, p=noise)
    present = sorted({c - stats.first_group for c, leaf in zip(tokens.classes, tokens.leaves) if leaf >= 0})
    draws = rng.random((len(present), LEAF_NOISE))
    other = {g: np.minimum(np.searchsorted(np.cumsum(leaf_noise[g]), d), size - 1) for g, d in zip(present, draws)}
    steps = [np.zeros(x.shape) for x in p]
    for i in range(n):
        context = [(0, tokens.w1[0, i]), (0, tokens.w1[1, i]), (1, tokens.w2[0, i]), (1, tokens.w2[1, i])]
        q = sum(p[k][row].astype(float) for k, row in context)
        told = [(2, 3, (c,), math.log(NOISE * max(noise[c], 1e-12)), y) for c, y in [(tokens.classes[i], 1), *((c, 0) for c in drawn)]]
        if tokens.leaves[i] >= 0:
            g = tokens.classes[i] - stats.first_group
            leaves = [(tokens.leaves[i], 1), *((leaf, 0) for leaf in other[g])]
            told += [(4, 5, (g, leaf), math.log(LEAF_NOISE * leaf_noise[g, leaf]), y) for leaf, y in leaves]
        q_step = np.zeros(DIMENSIONS)
        for targets, biases, at, log_noise, y in told:
            by = y - 1 / (1 + math.exp(-(q @ p[targets][at] + p[biases][at] - log_noise)))
            q_step += by * p[targets][at]
            steps[targets][at] += by * q / n
            steps[biases][at] += by / n
        for k, row in context:
            steps[k][row] += q_step / n
    for x, total, step in zip(p, sums, steps):
        total += step**2
        x += RATE * step / np.sqrt(total)


def test_a_batch_of_training_against_plain_sums():
    """Groups of no, few and many tokens; words that come once and often."""
    stats = statistics(5, groups=4, size=6)
    rng = np.random.default_rng(9)
    classes = rng.choice(stats.n_classes - 2, 400, p=[0, *[0.05] * 6, 0.65, 0.05]) + 0
    leaves = np.where(classes >= stats.first_group, rng.integers(0, 6, 400), -1)
    rows = rng.integers(0, stats.first_group + 41, (4, 400))
    rows[:, ::2] = 3
    tokens = Tokens(classes, leaves, rows[:2], rows[2:], np.zeros(400, int))
    got, want = initial(stats), [x.astype(float) for x in initial(stats)]
    sums, plain_sums = adagrad(got), [x.astype(float) for x in adagrad(want)]
    nce_epoch(got, sums, stats, tokens, np.random.default_rng(1))
    plain_batch(want, plain_sums, stats, tokens, np.random.default_rng(1))
    # The first step of Adagrad is nearly the sign of the gradient, so sums are compared, and steps that are not tiny.
    for k in range(6):
        assert np.allclose(sums[k], plain_sums[k], rtol=1e-3, atol=1e-9)
        clear = plain_sums[k] > 1e-5
        assert np.allclose(got[k][clear], want[k][clear], atol=1e-3)
