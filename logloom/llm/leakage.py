"""Evaluation items that stand, wholly or partly, in a corpus: greedy string tiling by running Karp-Rabin over shared word seeds.

Words of the items are numbered; any other word of a document is 0 and part of no match. A Karp-Rabin hash rolls over all windows of
``min_words`` numbers (or of a whole shorter item) of a batch of documents at once; a window whose hash is an item's seed makes the document
and the item a pair. In each pair the longest match is marked first, then the longest that is left of the unmarked words, and so on; what
the tiles cover of the item is found whatever the order in which its passages stand in the document. The length of the longest match is
found by hashing windows of one length on both sides, never by listing pairs of places, so that repetitive texts cost no more than others.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "item string, doc string, n_words bigint, n_tiles bigint, longest bigint, covered bigint"


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits of a text, after NFKC and lower-casing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower()) if text else []


def rolled(numbers: np.ndarray, n: int) -> np.ndarray:
    """The hashes, modulo 2^64, of all windows of ``n`` numbers."""
    out = np.zeros(max(0, len(numbers) - n + 1), dtype=np.uint64)
    for i in range(n):
        out = out * _BASE + numbers[i : i + len(out)].astype(np.uint64)
    return out


class _Side:
    """The words of one text, hashed so that windows of any length have their hashes at once, and which of them are marked."""

    def __init__(self, words: list[int], powers: np.ndarray):
        self.words, self._powers = words, powers
        values = np.array(words, dtype=np.uint64) + np.uint64(1)
        values = (values ^ (values >> np.uint64(31))) * _BASE
        # The hash of the words before each place, each times a power of the base: differences, brought to one power, are those of windows.
        self._before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[: len(words)], dtype=np.uint64)))
        self.marked = np.zeros(len(words), dtype=bool)
        if 0 in words:
            self.marked[np.array(words) == 0] = True

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of windows of ``n`` unmarked words, and their hashes."""
        taken = np.concatenate(([0], np.cumsum(self.marked)))
        at = np.flatnonzero(taken[n:] == taken[: len(taken) - n]) if n <= len(self.words) else np.zeros(0, np.int64)
        return at, (self._before[at + n] - self._before[at]) * self._powers[len(self._powers) - 1 - at]


def _longest_run(at: np.ndarray) -> int:
    """How many places follow each other at most."""
    breaks = np.flatnonzero(np.diff(at) != 1)
    return int(np.diff(np.concatenate(([-1], breaks, [len(at) - 1]))).max()) if len(at) else 0


def greedy_tiles(item: list[int], doc: list[int], n: int) -> list[tuple[int, int, int]]:
    """Tiles (start in the item, start in the document, length >= n) that don't overlap on either side: at each step the longest match of
    unmarked words, of equal ones that which is first in the item, then in the document. Words 0 match nothing.

    A step takes time in proportion to the words times the logarithm of the longest match, and places all tiles of one length; the lengths
    of its steps being different and the tiles not overlapping, there are at most sqrt(2 * words) steps, and mostly one.
    """
    powers = np.full(max(len(item), len(doc)) + 1, _BASE | np.uint64(1))
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    a, b = _Side(item, powers), _Side(doc, powers)

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (i, x), (j, y) = a.windows(length), b.windows(length)
        keep = np.isin(x, y)
        if not keep.any():
            return i[:0], x[:0], j[:0], y[:0]
        there = np.isin(y, x[keep])
        return i[keep], x[keep], j[there], y[there]

    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))
    while most >= n:
        found = shared(n)
        # No match is longer than the places of its first and last window of n words allow.
        low, high = n, min(most, n - 1 + min(_longest_run(found[0]), _longest_run(found[2])))
        if high < n:
            break
        probe = high
        while low < high:  # what is at most ``low`` long is shared
            longer = shared(probe)
            if len(longer[0]):
                low, found = probe, longer
            else:
                high = probe - 1
            probe = (low + high + 1) // 2
        places: dict[int, list[int]] = defaultdict(list)
        for j, h in zip(found[2].tolist(), found[3].tolist()):
            places[h].append(j)
        next_place = dict.fromkeys(places, 0)
        for i, h in zip(found[0].tolist(), found[1].tolist()):
            if a.marked[i : i + low].any():
                continue
            k, of_hash = next_place[h], places[h]
            while k < len(of_hash) and b.marked[of_hash[k] : of_hash[k] + low].any():
                k += 1
            next_place[h] = k
            if k < len(of_hash) and item[i : i + low] == doc[of_hash[k] : of_hash[k] + low]:
                tiles.append((i, of_hash[k], low))
                a.marked[i : i + low] = b.marked[of_hash[k] : of_hash[k] + low] = True
        most = low - 1  # all matches of this length are marked, but for words that agree in their hash only
    return tiles


class ItemIndex:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[str, str]], min_words: int):
        self.number: dict[str, int] = {}
        self.items: list[tuple[str, list[int], int]] = []
        seeds: dict[int, dict[int, dict[int, None]]] = defaultdict(lambda: defaultdict(dict))
        for key, text in items:
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if numbers:
                n = min(min_words, len(numbers))
                for h in rolled(np.array(numbers, dtype=np.uint64), n).tolist():
                    seeds[n][h][len(self.items)] = None
                self.items.append((key, numbers, n))
        self.seeds = {n: {h: list(of) for h, of in s.items()} for n, s in seeds.items()}
        self._sorted = {n: np.array(sorted(s), dtype=np.uint64) for n, s in self.seeds.items()}

    def numbers(self, text: str | None) -> list[int]:
        get = self.number.get
        return [get(w, 0) for w in words_of(text)]

    def search(self, docs: Iterable[list[int]], chunk_words: int = 500_000) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(document, item, words of the item, tiles, longest tile, words covered) of each pair that shares a seed.

        Documents are hashed together, as many as hold ``chunk_words`` words (a longer one by itself).
        """
        chunk: list[list[int]] = []
        first = n_words = 0
        for words in docs:
            if chunk and n_words + len(words) > chunk_words:
                yield from self._search(chunk, first)
                chunk, first, n_words = [], first + len(chunk), 0
            chunk.append(words)
            n_words += len(words)
        yield from self._search(chunk, first)

    def _search(self, docs: list[list[int]], first: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        whole = np.array([x for d in docs for x in (*d, 0)], dtype=np.uint64)
        begins = np.cumsum([0, *(len(d) + 1 for d in docs)])
        unknown = np.concatenate(([0], np.cumsum(whole == 0)))
        for n, seeds in self.seeds.items():
            if len(whole) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[: len(unknown) - n])
            hashes = rolled(whole, n)[at]
            there = np.minimum(np.searchsorted(self._sorted[n], hashes), len(self._sorted[n]) - 1)
            hit = self._sorted[n][there] == hashes
            owner = np.searchsorted(begins, at[hit], side="right") - 1
            # Each seed of a document once, however often it stands there.
            pairs = {(d, item): None for d, h in dict.fromkeys(zip(owner.tolist(), hashes[hit].tolist())) for item in seeds[h]}
            for d, item in pairs:
                numbers = self.items[item][1]
                tiles = greedy_tiles(numbers, docs[d], n)
                if tiles:
                    yield first + d, item, len(numbers), len(tiles), max(t[2] for t in tiles), sum(t[2] for t in tiles)


_INDEXES: dict[str, ItemIndex] = {}


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, min_words: int = 13, block_chars: int = 16_000_000) -> DataFrame:
    """(item_key, doc_key, n_words, n_tiles, longest, covered): each pair of an item and a document that share ``min_words`` words in a row.

    An item of fewer words must stand in the document whole. ``longest`` and ``covered`` count words of the item's tiles; covered / n_words is
    its coverage. Documents count each, copies too; so do items with equal texts. NULL, empty and wordless texts match nothing; rows
    with a NULL key are left out; an empty corpus or no items give no rows.

    The items are the stated query set. They fall into blocks by their keys' hashes, as many as hold ``block_chars`` characters each on
    average; a block at a time is read and broadcast, and compared with all documents. So what is broadcast at once, and what the driver holds,
    is of that size whatever the number of items; a process keeps one block's index. The corpus is read once for each block, and nothing of it
    is shuffled or sent to the driver.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    d = docs.select(F.col(doc_key).alias("k"), F.col(doc_text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    i = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    keys = d.schema["k"].dataType.simpleString(), i.schema["k"].dataType.simpleString()
    n_blocks = 1 + (i.agg(F.sum(F.char_length("t"))).first()[0] or 0) // block_chars

    def of_block(block: int) -> DataFrame:
        part = i.where(F.pmod(F.xxhash64("k"), F.lit(n_blocks)) == block).select(F.col("k").cast("string"), "t")
        shipped = d.sparkSession.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])
        name = uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _INDEXES:
                _INDEXES.clear()
                _INDEXES[name] = ItemIndex(shipped.value, min_words)
            index = _INDEXES[name]
            for b in batches:
                keys = b.column(0).to_pylist()
                found = list(index.search(map(index.numbers, b.column(1).to_pylist())))
                rows = [pa.array([index.items[f[1]][0] for f in found], pa.string()), pa.array([keys[f[0]] for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.array([f[c] for f in found], pa.int64()) for c in range(2, 6))], names=["item", "doc", "n_words", "n_tiles", "longest", "covered"])

        return d.select(F.col("k").cast("string"), "t").mapInArrow(search, _FOUND)

    found = reduce(DataFrame.union, map(of_block, range(n_blocks)))
    return found.select(F.col("item").cast(keys[1]).alias(item_key), F.col("doc").cast(keys[0]).alias(doc_key), "n_words", "n_tiles", "longest", "covered")
