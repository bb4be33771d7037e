from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from loglake.llm.common import vocabulary_path
from loglake.llm.op4_bpe import Encoder, encode, token_digests


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def test_hard_strings(library):
    encoder = Encoder(vocabulary_path())
    rng = random.Random(5)
    letters = "aabbcdehinort  '\n\t.,!123é世界🙂\x1c\x85\xa0​-_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    vocab = [w.replace("Ġ", " ") for w in rng.sample(sorted(library.get_vocab()), 3000)]
    texts += ["".join(rng.choice(vocab) for _ in range(4)) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", " ", "  ", " \n x", "don't WE'LL 's", "a" * 5000, "ab" * 300, ""]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids, text
        assert encoder.decode(ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_odd_rows_and_round_trip(library, odd):
    path = vocabulary_path()
    want = []
    for row in odd.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert back == (row.text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)]
        want.append((row.doc_id, len(ids), *digests))
    assert sorted(map(tuple, token_digests(odd, path).collect()), key=str) == sorted(want, key=str)
    assert sum(len(r.ids) for r in encode(odd, path).collect()) == sum(w[1] for w in want)


def test_empty_table(empty):
    assert token_digests(empty, vocabulary_path()).count() == 0
