"""Byte-level BPE of whole texts in time linear in their length, with the ids that repeated merging gives.

Bytes are mapped to Latin-1 characters, one for one, so that an Aho-Corasick automaton over all tokens finds, in one pass, the longest token
that begins at each byte. Tokens are taken greedily and taken back where the last two could not stand side by side in the result of the
merges; whether two tokens can is settled by undoing merges at their border, and remembered. No merge is ever carried out on a text. That a
sequence of tokens is the merges' result if and only if each two neighbours are is what makes this exact; the approach was published on the
GitHub engineering blog in December 2024 ("So many tokens, so little time").
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that parts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words and token pairs whose results a task remembers.
MAX_WORDS, MAX_PAIRS = 200_000, 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Tokens as Latin-1 strings by id, and the two tokens that each is merged from (itself for a single byte)."""

    tokens: tuple[str, ...]
    parts: tuple[tuple[int, int], ...]
    pattern: str = PATTERN


@lru_cache(maxsize=4)
def load_vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    """From a rank file: a line for each token, its bytes in base 64 and its id, which is also its rank among the merges."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    if any(t == "" for t in tokens):
        raise ValueError("the ids of the vocabulary must run from 0 without gaps")
    return Vocabulary(tuple(tokens), tuple(_merged_from(t, ranks) for t in tokens), pattern)


def _merged_from(token: str, ranks: dict[str, int]) -> tuple[int, int]:
    """The last merge that makes the token, by carrying out the merges of lower rank on its bytes."""
    pieces = list(token)
    while len(pieces) > 2:
        best = min(range(len(pieces) - 1), key=lambda i: ranks.get(pieces[i] + pieces[i + 1], len(ranks)))
        if pieces[best] + pieces[best + 1] not in ranks:
            raise ValueError(f"no merges make the token {token!r}")
        pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
    return (ranks[pieces[0]], ranks[pieces[-1]])


class Encoder:
    """Encodes texts; one for each worker process, as it remembers words and pairs of tokens."""

    def __init__(self, v: Vocabulary):
        import ahocorasick
        import regex

        self._split = regex.compile(v.pattern).findall
        self._length = [len(t) for t in v.tokens]
        self._parts = v.parts
        self._merges = {p: i for i, p in enumerate(v.parts) if len(v.tokens[i]) > 1}
        self._ids = {t: i for i, t in enumerate(v.tokens)}
        # The longest shorter token with which a token begins, -1 for single bytes.
        self._shorter = [next((self._ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self._ids), -1) for t in v.tokens]
        self._automaton = ahocorasick.Automaton()
        for i, t in enumerate(v.tokens):
            self._automaton.add_word(t, i)
        self._automaton.make_automaton()
        self._words: dict[str, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side: no merge over their border comes before the merges that made them.

        The halves at the border are taken apart, the later merge first; a merge over the border spoils the pair if its rank is lower than
        that of the merges taken apart so far. Of equal merges, the one further left comes first.
        """
        known = self._pairs.get((a, b))
        if known is not None:
            return known
        left, right, limit, good = a, b, len(self._parts), True
        while True:
            over = self._merges.get((left, right))
            if over is not None and over < limit:
                good = False
                break
            if left > right:
                limit, part = left, self._parts[left][1]
                if self._length[left] > 1:
                    left = part
                    continue
                if self._length[right] == 1:
                    break
                limit, right = right + 1, self._parts[right][0]
            else:
                if self._length[right] > 1:
                    limit, right = right + 1, self._parts[right][0]
                    continue
                if self._length[left] == 1:
                    break
                limit, left = left, self._parts[left][1]
        if len(self._pairs) >= MAX_PAIRS:
            self._pairs.clear()
        self._pairs[a, b] = good
        return good

    def encode_word(self, word: str) -> list[int]:
        """The ids of one part of a text, given as its bytes in Latin-1."""
        n, length = len(word), self._length
        longest = [-1] * n
        for end, i in self._automaton.iter(word):
            start = end - length[i] + 1
            if longest[start] < 0 or length[longest[start]] < length[i]:
                longest[start] = i
        dead = bytearray(n + 1)  # places from which no end was reached
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0 and (dead[at + length[token]] or before >= 0 and not self._adjacent(before, token)):
                token = self._shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("a byte is missing in the vocabulary")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self._words
        for w in self._split(text):
            ids = words.get(w)
            if ids is None:
                latin = w.encode("utf-8").decode("latin-1")
                i = self._ids.get(latin)
                ids = [i] if i is not None else self.encode_word(latin)
                if len(words) >= MAX_WORDS:
                    words.clear()
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; strings that look like these are ordinary text.

    Both a NULL and an empty text give the empty list; rows come out as often as they stand there, with NULL keys too; an empty input gives
    no rows. ``vocabulary`` is the path of a rank file, read on the driver and sent to the tasks, which keep one encoder a process. Nothing
    is shuffled; texts are encoded whole, one at a time.
    """
    v = load_vocabulary(vocabulary, pattern)
    shipped = df.sparkSession.sparkContext.broadcast(v)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hash_key not in _ENCODERS:
            _ENCODERS[hash_key] = Encoder(shipped.value)
        run = _ENCODERS[hash_key].encode
        for b in batches:
            ids = pa.array([run(t) if t else [] for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["key", "ids"])

    hash_key = hash((vocabulary, pattern, len(v.tokens)))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>").select(F.col("key").alias(key), "ids")
