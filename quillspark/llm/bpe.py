"""BPE encoding and decoding through a table of distinct words.

Words are what stands between ASCII white space. No pre-token of a tokenizer whose pattern
drops white space crosses it, nor does normalisation or an added token, so a text's ids are its
words' ids one after the other.

1. Split: every chunk of documents (about ``CHUNK_CHARS`` characters) numbers its words, keeps
   the numbers by position, and sends each of its distinct words once, packed by a hash bucket.
2. Encode: a bucket holds its words of all chunks; each distinct word is encoded once, and every
   chunk gets the ids of its words back in the order it sent them.
3. Join: a chunk's ids are joined to the positions.

Decoding joins ids to the tokenizer's pieces, a table as large as the vocabulary and no larger,
which is broadcast. Only packed distinct words and their ids are shuffled; positions
lie in a table bucketed by chunk, so that they don't move, and texts aren't kept; frequent
words travel once a chunk, so they make no hot key, and no bucket's or chunk's rows grow beyond
its share. Null texts count as empty and have no ids; null or repeated ids (doc_id) are kept row
by row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import pickle
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import durable_bucketed, lean, text_batches

CHUNK_CHARS = 10_000_000
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 256


def _squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte plane by byte plane."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pickle.dumps([zstandard.compress(np.ascontiguousarray(p).tobytes(), 3) for p in planes])


def _unsqueeze(packed: bytes) -> np.ndarray:
    planes = [np.frombuffer(zstandard.decompress(p), dtype=np.uint8) for p in pickle.loads(packed)]
    return np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()


class _Numbering(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _split(n_buckets: int):
    """Documents to rows (kind, chunk, bucket, payload): positions, and distinct words by bucket."""

    def pack(chunk: int, ids: list, counts: list[int], places: list[np.ndarray], seen: _Numbering) -> Iterator[pa.RecordBatch]:
        words = list(seen)
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), dtype=np.uint32, count=len(words))
        at = np.concatenate(places) if places else np.zeros(0, dtype=np.uint32)
        rows = [("positions", chunk, -1, pickle.dumps((ids, _squeeze(np.array(counts, dtype=np.uint32)), _squeeze(at), _squeeze(bucket))))]
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in np.unique(bucket):
            mine = order[ends[b] : ends[b + 1]]
            rows.append(("words", chunk, int(b), zstandard.compress(b"\n".join([words[i] for i in mine]), 3)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["kind", "chunk", "bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 24, 0
        ids, counts, places, seen = [], [], [], _Numbering()
        for batch in batches:
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                words = (text.as_py() or "").encode().split()
                ids.append(doc_id)
                counts.append(len(words))
                places.append(np.array([seen[w] for w in words], dtype=np.uint32))
                size += sum(map(len, words)) + 64
                if size >= CHUNK_CHARS:
                    yield from pack(chunk, ids, counts, places, seen)
                    chunk, size = chunk + 1, 0
                    ids, counts, places, seen = [], [], [], _Numbering()
        if ids:
            yield from pack(chunk, ids, counts, places, seen)

    return run


def _tokenizer(json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(json)
    made.no_truncation()
    made.no_padding()
    return made


def _encode_words(json):
    """Packed words, sorted by bucket, to packed ids; each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bucket, known = _tokenizer(json.value), None, {}
        for batch in batches:
            out = []
            for chunk, b, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if b != bucket:
                    bucket, known = b, {}
                words = zstandard.decompress(payload).split(b"\n")
                fresh = [w for w in words if w not in known]
                for w, e in zip(fresh, model.encode_batch([w.decode() for w in fresh], add_special_tokens=False)):
                    known[w] = np.array(e.ids, dtype="<u4").tobytes()
                found = [known[w] for w in words]
                lengths = np.fromiter((len(x) // 4 for x in found), dtype=np.uint32, count=len(found))
                out.append((chunk, b, pickle.dumps((_squeeze(lengths), _squeeze(np.frombuffer(b"".join(found), dtype="<u4"))))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["of", "bucket", "payload"])

    return run


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _join_positions(positions: pa.Table, encoded: pa.Table) -> pa.Table:
    if not positions.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
    ids, counts, at, bucket = pickle.loads(positions.column("payload")[0].as_py())
    counts, at, bucket = _unsqueeze(counts).astype(np.int64), _unsqueeze(at), _unsqueeze(bucket)
    pairs = zip(encoded.column("bucket").to_pylist(), encoded.column("payload").to_pylist())
    back = [(b, *pickle.loads(p)) for b, p in sorted(pairs, key=lambda x: x[0])]
    sorted_lengths = np.concatenate([_unsqueeze(x[1]) for x in back]).astype(np.int64) if back else np.zeros(0, dtype=np.int64)
    flat = np.concatenate([_unsqueeze(x[2]) for x in back]) if back else np.zeros(0, dtype=np.uint32)
    order = np.argsort(bucket, kind="stable")
    lengths, starts = np.empty_like(sorted_lengths), np.empty_like(sorted_lengths)
    lengths[order], starts[order] = sorted_lengths, np.cumsum(sorted_lengths) - sorted_lengths
    out, place = [], 0
    for n in counts:
        mine = at[place : place + n]
        place += n
        out.append(flat[_ragged(starts[mine], lengths[mine])].astype("<u4").tobytes())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(out, pa.binary())})


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids of every row; ids are unsigned 32-bit little-endian numbers in one binary."""
    spark = docs.sparkSession
    text_batches(spark)
    json = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    n_buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = durable_bucketed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_split(n_buckets)), "kind string, chunk long, bucket int, payload binary"), "bpe-words", "chunk", "kind")
    words = packed.where("kind = 'words'").select("chunk", "bucket", "payload")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_encode_words(json)), "of long, bucket int, payload binary")
    positions = packed.where("kind = 'positions'").select("chunk", "payload")
    return positions.groupBy("chunk").cogroup(ids.groupBy("of")).applyInArrow(_join_positions, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Add ``text``, the pieces of a row's ids joined by the tokenizer's separator, to (doc_id, ids).

    For tokenizers without a decoder of their own, whose pieces are joined by one space. Ids
    that the vocabulary lacks have no piece and are left out.
    """
    model = _tokenizer(Path(tokenizer_path).read_text(encoding="utf-8"))
    if model.decoder is not None:
        raise ValueError("only tokenizers that join their pieces by a space are decoded here")
    pieces = encoded.sparkSession.sparkContext.broadcast([model.id_to_token(i) for i in range(max(model.get_vocab().values()) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(pieces.value, dtype=object)
        for whole in batches:
            for start in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(start, OUT_ROWS)
                texts = []
                for ids in batch.column(1).to_pylist():
                    numbers = np.frombuffer(ids or b"", dtype="<u4")
                    found = table[numbers[numbers < len(table)]].tolist()
                    texts.append(" ".join(found if None not in found else [p for p in found if p is not None]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, ids binary, text string")
