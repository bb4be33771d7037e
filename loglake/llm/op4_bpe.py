"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that byte-pair encoding produces. It begins with one state and an arc
back to it for every byte. Merges are applied in order, each by one gadget: for ``u v -> uv``, the state that u-arcs
lead to is copied without its v-arc, the u-arcs lead to the copy, and every state that has a u-arc gets a uv-arc to
where the v-arc led. All arcs of one token thus lead to one state. Arcs are not listed: a state is its parent at the
time of the copy, less the arcs removed since, and has an arc for a merged token if it had one for the token's left
part when the merge was applied.

Encoding walks the automaton over the bytes of a pre-split word: every prefix has one accepted sequence, so one state,
and a prefix that turns out not to lead on is not tried again.
Decoding concatenates the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loglake.llm.words import text_chunks

RESULT_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKEN_SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string"
START = 0
NEVER = -1
CACHED = 400_000
CACHED_LENGTH = 64

# White space of Unicode, and the published pre-split pattern of the byte-level vocabulary.
SPACES = "\t-\r \x85\xa0  -     　"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Automaton:
    """States and arcs after all merges; tokens are numbered as in the vocabulary."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels = {i: t for t, i in vocab.items()}
        singles = [vocab[bytes([b])] for b in range(256)]
        self.left: dict[int, int] = {}
        self.formed: dict[int, int] = dict.fromkeys(singles, NEVER)
        self.target: dict[int, int] = dict.fromkeys(singles, START)
        self.parent: list[int] = [NEVER]
        self.copied: list[int] = [NEVER]
        self.removed: dict[int, int] = {}
        self._known: dict[int, bool] = {}
        users = {START: 257}  # the start itself counts: it never changes
        for time, (u, v) in enumerate(merges):
            self._merge(time, vocab[u], vocab[v], vocab[u + v], users)
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [NEVER]
        self.sizes = {t: len(label) for t, label in self.labels.items()}
        for token in self.target:
            node = 0
            for b in self.labels[token]:
                step = node << 8 | b
                if step not in self.trie:
                    self.trie[step] = len(self.token_at)
                    self.token_at.append(NEVER)
                node = self.trie[step]
            self.token_at[node] = token

    def _merge(self, time: int, u: int, v: int, uv: int, users: dict[int, int]) -> None:
        state = self.target.get(u)
        if state is None or v not in self.target or uv in self.target or not self._present(state, v, time):
            return
        beyond = self.target[v]
        if users[state] > 1 or u == v:
            users[state] -= 1
            self.parent.append(state)
            self.copied.append(time)
            self.target[u] = state = len(self.parent) - 1
            users[state] = 1
        self.removed[state << 20 | v] = time
        self.left[uv], self.formed[uv], self.target[uv] = u, time, beyond
        users[beyond] += 1

    def _removal(self, state: int, token: int) -> int | None:
        """When the arc went, from this state or from one that it is a copy of."""
        removed, formed = self.removed, self.formed[token]
        gone = removed.get(state << 20 | token)
        while (parent := self.parent[state]) != NEVER and formed <= (copied := self.copied[state]):
            before = removed.get(parent << 20 | token)
            if before is not None and before < copied:
                gone = before
            state = parent
        return gone

    def _present(self, state: int, token: int, time: int) -> bool:
        gone = self._removal(state, token)
        if gone is not None and gone <= time:
            return False
        return self.formed[token] == NEVER or self._present(state, self.left[token], self.formed[token])

    def has_arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        known = self._known.get(key)
        if known is None:
            if len(self._known) > CACHED:
                self._known.clear()
            known = self._known[key] = self._present(state, token, len(self.labels))
        return known

    def encode(self, word: bytes) -> list[int]:
        """Tokens on the one accepted path over ``word``: longest arcs first, no prefix is tried twice."""
        n, at, state = len(word), 0, START
        trie, token_at, target, known = self.trie.get, self.token_at, self.target, self._known.get
        path: list[int] = []
        before: list[tuple[int, int]] = []  # place and state at which each token of the path begins
        choices: list[list[int]] = []
        dead: set[int] = set()
        while at < n:
            node, matches = 0, []
            for j in range(at, n):
                node = trie(node << 8 | word[j])
                if node is None:
                    break
                token = token_at[node]
                if token >= 0:
                    matches.append(token)
            choices.append(matches)
            while True:
                if not choices[-1]:
                    # No accepted path goes on from here.
                    dead.add(at)
                    choices.pop()
                    path.pop()
                    at, state = before.pop()
                    continue
                token = choices[-1].pop()
                arc = known(state << 20 | token)
                if (self.has_arc(state, token) if arc is None else arc) and at + self.sizes[token] not in dead:
                    break
            path.append(token)
            before.append((at, state))
            at, state = at + self.sizes[token], target[token]
        return path


Entry = tuple[int, str, bytes, bytes]  # token count, numbers joined by commas, decoded bytes, numbers as 32-bit integers


class Encoder:
    """Whole texts to tokens; results of short words are kept, in two generations, for the next ones."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        names = byte_names()

        def raw(token: str) -> bytes:
            return bytes(names[c] for c in token)

        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {raw(t): i for t, i in data["model"]["vocab"].items() if t not in added}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"])
        self.automaton = Automaton(vocab, [(raw(u), raw(v)) for u, v in pairs])
        self.added = added
        self._reset()

    def _reset(self) -> None:
        self._word = regex.compile(SPLIT)
        self._run = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        longest = sorted(self.added, key=len, reverse=True)
        self._added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._young: dict[str, Entry] = {}
        self._old: dict[str, Entry] = {}

    def __getstate__(self):
        return {"automaton": self.automaton, "added": self.added}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def _tokens(self, run: str) -> list[int]:
        """White space and the word after it: none of the split pattern's matches goes further."""
        out: list[int] = []
        pieces = self._pieces
        # Letters only, after a blank or none, are one match; most words need no pattern.
        whole = run.isalpha() or (run[0] == " " and run[1:].isalpha())
        for piece in (run,) if whole else self._word.findall(run):
            known = pieces.get(piece)
            if known is None:
                known = tuple(self.automaton.encode(piece.encode()))
                if len(piece) <= CACHED_LENGTH:
                    if len(pieces) > CACHED:
                        pieces.clear()
                    pieces[piece] = known
            out += known
        return out

    def _entry(self, run: str) -> Entry:
        found = self._old.get(run)
        if found is None:
            ids = self._tokens(run)
            found = len(ids), ",".join(map(str, ids)), self.decode(ids), array("i", ids).tobytes()
        if len(run) <= CACHED_LENGTH:
            if len(self._young) >= CACHED:
                self._old, self._young = self._young, {}
            self._young[run] = found
        return found

    def decode(self, ids: list[int]) -> bytes:
        labels = self.automaton.labels
        return b"".join([labels[i] if i in labels else self._special(i) for i in ids])

    def _special(self, token: int) -> bytes:
        return next(t for t, i in self.added.items() if i == token).encode()

    def _entries(self, text: str) -> Iterator[Entry]:
        for k, part in enumerate(self._added.split(text) if self._added else [text]):
            if k % 2:
                yield 1, str(self.added[part]), part.encode(), array("i", [self.added[part]]).tobytes()
            else:
                get = self._young.get
                for run in self._run.findall(part):
                    found = get(run)
                    if found is None:
                        found = self._entry(run)
                        get = self._young.get
                    yield found

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)[0]).tolist()

    def packed(self, text: str) -> tuple[bytes, str]:
        """Token numbers as 32-bit integers, digest of the decoded text."""
        found = list(self._entries(text))
        decoded = b"".join([x[2] for x in found]).decode("utf-8", "replace").encode()
        return b"".join([x[3] for x in found]), hashlib.sha256(decoded).hexdigest()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count, digest of the token numbers, digest of the decoded text."""
        found = list(self._entries(text))
        decoded = b"".join([x[2] for x in found]).decode("utf-8", "replace").encode()
        ids = ",".join([x[1] for x in found])
        return sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _over_texts(docs: DataFrame, path: str, schema: str, columns) -> DataFrame:
    """The automaton is compiled once; its size is that of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for first, texts in text_chunks(batch, "text"):
                ids = batch["doc_id"].slice(first, len(texts))
                yield columns(encoder, ids, [t.decode() if t else "" for t in texts])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text; others are ignored).

    ``path`` is a vocabulary file that all executors have. The encoding of added tokens in a text is their own
    number; a null text is encoded as an empty one: no tokens, digests of the empty string. Each row is encoded on
    its own, whatever its doc_id.
    """

    def columns(encoder: Encoder, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        n, encoded, decoded = zip(*map(encoder.digest, texts))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _over_texts(docs, path, RESULT_SCHEMA, columns)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the token numbers, and the digest of the decoded text of every row, as in token_digests."""

    def columns(encoder: Encoder, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        packed, decoded = zip(*map(encoder.packed, texts))
        numbers = np.frombuffer(b"".join(packed), np.int32)
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(numbers))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes), tokens, pa.array(decoded)], ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        )

    return _over_texts(docs, path, TOKEN_SCHEMA, columns)
