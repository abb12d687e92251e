"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item is inside a document if the document holds at least ``CONTAINMENT`` of the item's
distinct shingles (``SHINGLE_WORDS`` words, A-Z lower-cased, split at ASCII white space; the
whole word sequence of a shorter text; a text without words has none and matches nothing).

Items are partitioned by their number of shingles. An item's sketch is its least hashes: of an
item of n shingles, m of which a document must hold, the n - m + h least, where h follows the
size partition. A document that holds m shingles lacks at most n - m of the sketch, so it holds
h of it at least, wherever in it they stand: the bound leaves no pair out, at any size, and a
larger h leaves fewer candidates to large items. The sketches are of 64-bit hashes, whose
collisions only add candidates; every candidate is verified against the whole document by exact
comparison of shingle strings.

Documents are not shuffled. Items go to them in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters, each block broadcast for one pass, so a large benchmark means more
passes and never a larger broadcast. Null ids match row by row; repeated items and documents
give a row for each pair of rows; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import lean, text_batches

SHINGLE_WORDS, CONTAINMENT, SEED = 5, 0.8, 977
BLOCK_ITEMS, BLOCK_CHARS, CACHE_WORDS = 20_000, 16_000_000, 300_000
#: Size partitions: items of up to so many shingles need so many hits of their sketch.
SIZE_PARTITIONS = [(8, 1), (32, 2), (128, 4), (1 << 62, 8)]
_RNG = np.random.default_rng(SEED)
_STEP = _RNG.integers(0, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _in_order(words: list[bytes]) -> list[bytes]:
    return [b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))] if words else []


def shingles_of(words: list[bytes]) -> set[bytes]:
    return set(_in_order(words))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _shingle_hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    """A hash of every shingle in order, from its words' hashes."""
    h = np.array([known[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - SHINGLE_WORDS + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE_WORDS else SHINGLE_WORDS, dtype=np.uint64)
    for k in range(min(SHINGLE_WORDS, len(h))):
        out = (out ^ h[k : k + n]) * _STEP[k]
        out ^= out >> np.uint64(31)
    return out


def sketch(words: list[bytes], known: _Hashes) -> tuple[list[int], int]:
    """The least hashes of an item's shingles, and how many of them a document with the item holds."""
    n = len(shingles_of(words))
    lacking = n - ceil(CONTAINMENT * n)
    hits = next(h for most, h in SIZE_PARTITIONS if n <= most)
    least = np.unique(_shingle_hashes(words, known))[: lacking + hits].tolist()
    return least, max(1, len(least) - lacking)


class Searcher:
    """A block of items and the index of their sketches."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.items = [(i, shingles_of(words_of(t))) for i, t in items]
        self.known = _Hashes()
        self.places: dict[int, list[int]] = defaultdict(list)
        self.needed = [0] * len(items)
        for place, (_, text) in enumerate(items):
            if words := words_of(text):
                least, self.needed[place] = sketch(words, self.known)
                for value in least:
                    self.places[value].append(place)
        self.keys = np.array(sorted(self.places), dtype=np.uint64)

    def candidates(self, batch: list[list[bytes]]) -> list[set[int]]:
        """Items that may be inside each document of a batch, given as words."""
        found: list[set[int]] = [set() for _ in batch]
        if not len(self.keys):
            return found
        for places, words in zip(found, batch):
            if words:
                hashes = _shingle_hashes(words, self.known)
                at = np.searchsorted(self.keys, hashes)
                at[at == len(self.keys)] = 0
                hits = Counter(p for value in set(hashes[self.keys[at] == hashes].tolist()) for p in self.places[value])
                places.update(p for p, n in hits.items() if n >= self.needed[p])
        return found


def _search(shipped, at_id: int, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(shipped.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                words = [words_of(t.as_py()) for t in batch.column(at_text)]
                rows = []
                for doc_id, own, places in zip(batch.column(at_id).to_pylist(), words, searcher.candidates(words)):
                    held = shingles_of(own) if places else set()
                    for place in sorted(places):
                        item, shingles = searcher.items[place]
                        shared = len(shingles & held)
                        if shared >= CONTAINMENT * len(shingles):
                            rows.append((doc_id, item, len(shingles), shared))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["row", "item_id", "n_shingles", "n_shared"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of bounded size, streamed partition by partition."""
    text_batches(items.sparkSession)
    block, chars = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if text:
            block.append((item_id, text))
            chars += len(text)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _matches(docs: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """(row, item_id, n_shingles, n_shared); ``row`` is the value of ``key``, a long."""
    spark, found = docs.sparkSession, None
    for block in _blocks(items):
        part = docs.select(key, "text").mapInArrow(lean(_search(spark.sparkContext.broadcast(block), 0, 1)), "row long, item_id long, n_shingles long, n_shared long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "row long, item_id long, n_shingles long, n_shared long")
    return found


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared of every item inside a document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _matches(slim, "doc_id", items).withColumnRenamed("row", "doc_id")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    at = docs.columns.index("text")

    def drop(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shipped.value)
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    words = [words_of(t.as_py()) for t in batch.column(at)]
                    keep = []
                    for own, places in zip(words, searcher.candidates(words)):
                        held = shingles_of(own) if places else set()
                        keep.append(not any(len(s & held) >= CONTAINMENT * len(s) for s in (searcher.items[p][1] for p in places)))
                    yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for block in _blocks(items):
        docs = docs.mapInArrow(lean(drop(docs.sparkSession.sparkContext.broadcast(block))), docs.schema)
    return docs
