"""Byte-level BPE encoding and decoding through one shuffle of distinct pre-tokens.

A rank file's tokenizer merges within the matches of its pattern only, so a text's ids are those
of its matches one after the other.

1. Explode: each chunk of documents (about ``CHUNK_BYTES`` of text) splits its texts into matches and numbers
   the distinct ones, the most frequent first. Positions (one number a match) go to a table bucketed by
   chunk; the distinct words go out once a chunk, packed by hash bucket.
2. Encode: all chunks' words of a bucket meet in one partition, where each distinct word is encoded once.
3. Join back: the ids return to their chunk, take the order in which it numbered its words, and are
   laid out by position.

Decoding joins ids to the table of the tokens' bytes. That table is as large as the vocabulary and no
larger, so it goes to every task, which looks its rows' ids up there.

A frequent word travels once a chunk, so it makes no hot key; buckets follow the session's shuffle partitions, and
a partition holds at most ``KNOWN_WORDS`` encoded words before it starts anew (a word may be encoded again
then), so memory stays bounded. Numbers travel as byte planes, columns that Parquet compresses well. Null texts
count as empty and have no ids, invalid UTF-8 reads as U+FFFD; null or repeated ids (doc_id) are kept
row by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable_bucketed, lean, text_batches

CHUNK_BYTES = 8_000_000
KNOWN_WORDS = 1_000_000
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 256
PLANES = ("b0", "b1", "b2", "b3")
_SPLIT = "kind string, chunk long, bucket int, n int, docs array<long>, counts array<int>, buckets array<int>, " + ", ".join(f"{p} binary" for p in PLANES) + ", words binary"
_SPLIT_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 5)
_WORDS = "of long, bucket int, lengths binary, ids binary"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines (base64, rank) of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, which is how the tokenizer's own engine reads it."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _planes(numbers: np.ndarray) -> list[bytes]:
    """The bytes of unsigned 32-bit numbers, all lowest bytes first, then the next."""
    return [np.ascontiguousarray(p).tobytes() for p in numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def _numbers(planes: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)).view("<u4").ravel()


def _squeeze(numbers: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(_planes(numbers)), 3)


def _unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Numbering(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(words: list[bytes]) -> bytes:
    """Words with their lengths before them, compressed."""
    lengths = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return zstandard.compress(lengths.tobytes() + b"".join(words), 3)


def _unpack(packed: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(packed)
    ends = (np.cumsum(np.frombuffer(raw, dtype="<u4", count=n), dtype=np.int64) + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends], ends)]


def _explode(pattern: str, n_buckets: int):
    """Documents to a row of positions for each chunk, and a row of distinct words for each bucket in it."""

    def chunk_rows(chunk: int, docs: list, counts: list[int], places: list[np.ndarray], seen: _Numbering) -> pa.RecordBatch:
        at = np.concatenate(places)
        frequent = np.argsort(-np.bincount(at, minlength=len(seen)), kind="stable")
        rank = np.empty(len(seen), dtype=np.uint32)
        rank[frequent] = np.arange(len(seen), dtype=np.uint32)
        spelled = list(seen)
        words = [spelled[i].encode() for i in frequent]
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), dtype=np.int32, count=len(words))
        rows = [("positions", chunk, None, len(at), docs, counts, bucket, *_planes(rank[at]), None)]
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in np.unique(bucket).tolist():
            mine = order[ends[b] : ends[b + 1]]
            rows.append(("words", chunk, b, len(mine), None, None, None, *[None] * 4, _pack([words[i] for i in mine])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SPLIT_TYPES)], names=[c.split()[0] for c in _SPLIT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, chunk, size = splitter(pattern).findall, TaskContext.get().partitionId() << 24, 0
        docs, counts, places, seen = [], [], [], _Numbering()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = find((text.as_py() or b"").decode("utf-8", "replace"))
                docs.append(doc_id)
                counts.append(len(words))
                places.append(np.fromiter(map(seen.__getitem__, words), dtype=np.uint32, count=len(words)))
                size += text.as_buffer().size + 64 if text.is_valid else 64
                if size >= CHUNK_BYTES:
                    yield chunk_rows(chunk, docs, counts, places, seen)
                    chunk, size = chunk + 1, 0
                    docs, counts, places, seen = [], [], [], _Numbering()
        if docs:
            yield chunk_rows(chunk, docs, counts, places, seen)

    return run


def _encode_words(ranks):
    """Packed words, sorted by bucket, to their ids; each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # The pattern takes a word whole: its own matches were found before.
        encode = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=read_ranks(ranks.value), special_tokens={}).encode_ordinary
        bucket, known = None, {}
        for batch in batches:
            out = []
            for chunk, b, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket or len(known) > KNOWN_WORDS:
                    bucket, known = b, {}
                words = _unpack(packed, n)
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w.decode()), dtype=np.uint32)
                found = [known[w] for w in words]
                out.append((chunk, b, _squeeze(np.fromiter(map(len, found), dtype=np.uint32, count=n)), _squeeze(np.concatenate(found))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["of", "bucket", "lengths", "ids"])

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a column of lists, one list after the other."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if column.num_chunks else np.zeros(0, dtype=np.int64)


def _lay_out(positions: pa.Table, encoded: pa.Table) -> pa.Table:
    """Ids of a chunk's documents, from its positions and the ids of its words."""
    schema = pa.schema({"doc_id": pa.int64(), "ids": pa.list_(pa.int32())})
    if not positions.num_rows:
        return schema.empty_table()
    encoded = encoded.sort_by("bucket")
    none = [np.zeros(0, dtype=np.uint32)]
    lengths_back = np.concatenate([_unsqueeze(x) for x in encoded.column("lengths").to_pylist()] or none).astype(np.int64)
    flat = np.concatenate([_unsqueeze(x) for x in encoded.column("ids").to_pylist()] or none)
    order = np.argsort(_flat(positions.column("buckets")), kind="stable")
    lengths, starts = np.empty_like(lengths_back), np.empty_like(lengths_back)
    lengths[order], starts[order] = lengths_back, np.cumsum(lengths_back) - lengths_back
    at = _numbers([positions.column(p)[0].as_py() for p in PLANES])
    counts = _flat(positions.column("counts")).astype(np.int64)
    pieces, place = [], 0
    n_ids = np.zeros(len(counts) + 1, dtype=np.int32)
    for i, n in enumerate(counts.tolist()):
        mine = at[place : place + n]
        place += n
        pieces.append(flat[ragged(starts[mine], lengths[mine])])
        n_ids[i + 1] = len(pieces[-1])
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum(n_ids, dtype=np.int32)), pa.array(np.concatenate(pieces).astype(np.int32)))
    return pa.Table.from_arrays([positions.column("docs")[0].values, ids], schema=schema)


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row, by the content of a rank file and the pattern that splits texts."""
    spark = docs.sparkSession
    text_batches(spark)
    n_buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    split = durable_bucketed(texts.mapInArrow(lean(_explode(pattern, n_buckets)), _SPLIT), "pre-tokens", "chunk", "kind")
    words = split.where("kind = 'words'").select("chunk", "bucket", "n", "words")
    shared = spark.sparkContext.broadcast(ranks)
    back = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_encode_words(shared)), _WORDS)
    positions = split.where("kind = 'positions'").select("chunk", "docs", "counts", "buckets", *PLANES)
    return positions.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_lay_out, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Add ``bytes``, the tokens' bytes one after the other, to (doc_id, ids); ids without a token have none."""
    by_id = {i: token for token, i in read_ranks(ranks).items()}
    table = encoded.sparkSession.sparkContext.broadcast([by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.array([*table.value, b""], dtype=object)
        for whole in batches:
            for start in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(start, OUT_ROWS)
                joined = []
                for ids in batch.column(1):
                    numbers = ids.values.to_numpy(zero_copy_only=False).astype(np.int64) if ids.is_valid else np.zeros(0, dtype=np.int64)
                    numbers[(numbers < 0) | (numbers >= len(tokens))] = len(tokens) - 1
                    joined.append(b"".join(tokens[numbers].tolist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids array<int>, bytes binary")
