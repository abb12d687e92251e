"""Alignment of two tokenizers' tokens over the same bytes, with counts of linked token ids.

A text's tokens of A (byte-level BPE over a space and the text) and of B (SentencePiece, which adds
the space itself) spell the same bytes. Where tokens of both end, the text is cut into groups; a
group links each of its A tokens with each of its B tokens.

1. Align: an Arrow batch's tokens are laid end to end, documents after one another, so a running sum
   of token lengths gives every token's end in the batch. One ``bincount`` of A's and B's ends
   together has 2 where both end; running sums of these cuts number the groups, and differences of
   running sums at the documents' bounds give each document's own figures. Tokens go to a table
   bucketed by chunk (about ``CHUNK_BYTES`` of text); their ends are summed up again where they are read.
2. Count: a chunk sends each linked pair of ids once, with the number of its documents that hold it;
   the sums are a pair's count, and the greatest count of an A id is broadcast (no more entries than
   A's vocabulary).
3. Join back: the counts of a chunk's pairs return to it and are summed up over its links.

A pair travels once a chunk however frequent it is, so no key is hot and no group grows with the
corpus. Groups of many tokens are linked by their distinct ids. Texts that are null or empty or that
either tokenizer doesn't spell byte by byte have no tokens: zeros and '' as groups. Repeated and
null ids (doc_id) are rows of their own and count as documents each; extra columns are ignored; an
empty table gives no rows. A text is encoded whole, however long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.byte_bpe import ragged, splitter
from quillspark.llm.common import durable, durable_bucketed, lean, text_batches

CHUNK_BYTES = 4_000_000
#: Bytes of texts that are aligned at once, and links of a group that are listed one by one; larger groups go by distinct ids.
STEP_BYTES, MANY_LINKS = 500_000, 1 << 16
#: Characters from which a text is split into matches before it is encoded: the tokenizer's own
#: engine gives up on very long runs of white space.
LONG_TEXT = 100_000
_ALIGNED = "kind string, chunk long, doc_id long, a array<int>, b array<int>, pairs array<long>, docs array<int>"
_ALIGNED_SCHEMA = pa.schema({"kind": pa.string(), "chunk": pa.int64(), "doc_id": pa.int64(), "a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "docs": pa.list_(pa.int32())})
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_RESULT_SCHEMA = pa.schema({"doc_id": pa.int64(), **{c: pa.int64() for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}, "groups": pa.string()})


def byte_level_tokens(tokenizer_json: str) -> dict[bytes, int]:
    """Bytes to id of a byte-level BPE vocabulary whose ids follow the order of its merges.

    Bytes that print stand for themselves in its entries, the others for characters from 256 on.
    """
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}
    read = json.loads(tokenizer_json)
    special = {t["content"] for t in read["added_tokens"] if t["special"]}
    vocab = {entry: i for entry, i in read["model"]["vocab"].items() if entry not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in read["model"]["merges"]]
    if [vocab[m] for m in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("only vocabularies whose ids follow their merges are read here")
    return {bytes(byte_of[c] for c in entry): i for entry, i in vocab.items()}


def piece_bytes(model) -> list[bytes]:
    """Bytes of every piece of a SentencePiece model: U+2581 is a space, <0xHH> a byte."""
    spelled = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return [spelled(i) for i in range(model.get_piece_size())]


class _Pair:
    """The two tokenizers in a worker, and their tokens' bytes and lengths by id."""

    def __init__(self, tokens: dict[bytes, int], model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        made = lambda p: tiktoken.Encoding("a", pat_str=p, mergeable_ranks=tokens, special_tokens={}).encode_ordinary
        self._whole, self._match, self._find = made(pattern), made("(?s:.+)"), splitter(pattern).findall
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        by_id = {i: t for t, i in tokens.items()}
        a, b = [by_id.get(i, b"") for i in range(max(by_id) + 1)], piece_bytes(self._pieces)
        self.bytes = [np.array([*x, None], dtype=object)[:-1] for x in (a, b)]
        self.lengths = [np.array(list(map(len, x)), dtype=np.int64) for x in (a, b)]
        self.sizes = (len(a), len(b))

    def encode(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B; none if either spells other bytes than a space and the text."""
        none = np.zeros(0, dtype=np.int64)
        if not text:
            return none, none
        read, wanted = text.decode("utf-8", "replace"), b" " + text
        a = self._whole(" " + read) if len(read) < LONG_TEXT else [i for word in self._find(" " + read) for i in self._match(word)]
        found = np.array(a, dtype=np.int64), np.array(self._pieces.encode(read, num_threads=1), dtype=np.int64)
        return found if all(b"".join(t[x].tolist()) == wanted for t, x in zip(self.bytes, found)) else (none, none)


def cut(ids: tuple[np.ndarray, np.ndarray], lengths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and of B in every group, and the number of groups up to each byte, of texts laid end to end."""
    ends = [np.cumsum(size[x]) for size, x in zip(lengths, ids)]
    both = np.bincount(np.concatenate(ends), minlength=1) == 2
    upto = np.cumsum(both)
    n = int(upto[-1])
    sizes = [np.bincount(upto[e] - both[e], minlength=n) for e in ends]
    return sizes[0], sizes[1], upto


def links(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair, times) of all links, in pieces of bounded size; a pair is a * width + b.

    Within a group of few links each is listed by itself; many links of a group are listed by pair.
    """
    a_from, b_from = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    many = a_sizes * b_sizes > MANY_LINKS
    group = np.repeat(np.arange(len(a_sizes)), a_sizes)
    mine = np.flatnonzero(~many[group])
    total = np.cumsum(b_sizes[group[mine]])
    for low in range(0, int(total[-1]) if len(total) else 0, 1 << 21):
        part = mine[np.searchsorted(total, low, side="right") : np.searchsorted(total, low + (1 << 21), side="right")]
        n = b_sizes[group[part]]
        pair = np.repeat(a[part] * width, n) + b[ragged(b_from[group[part]], n)]
        yield np.repeat(group[part], n), pair, np.ones(len(pair), dtype=np.int64)
    for g in np.flatnonzero(many).tolist():
        kinds, n = zip(*(np.unique(x[s[g] : s[g] + k[g]], return_counts=True) for x, s, k in ((a, a_from, a_sizes), (b, b_from, b_sizes))))
        rows = max(1, (1 << 21) // len(kinds[1]))
        for low in range(0, len(kinds[0]), rows):
            pair = (kinds[0][low : low + rows, None] * width + kinds[1]).ravel()
            yield np.full(len(pair), g), pair, (n[0][low : low + rows, None] * n[1]).ravel()


def _held(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, doc_of: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """The distinct pairs of every document, one document after the other."""
    every = sizes[0] * sizes[1]
    found = [np.unique(doc_of[group] * every + pair) for group, pair, _ in links(a, b, a_sizes, b_sizes, sizes[1])]
    return (np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, dtype=np.int64)) % every


def _steps(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``STEP_BYTES``."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or b"") + 1
        if size >= STEP_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _ALIGNED_SCHEMA], schema=_ALIGNED_SCHEMA)


def _align(shared, pattern: str):
    """Documents to rows of their tokens and groups, and to a row of the pairs of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, chunk, size, held = _Pair(*shared.value, pattern), TaskContext.get().partitionId() << 24, 0, []

        def counted() -> pa.RecordBatch:
            pairs, docs = np.unique(np.concatenate(held), return_counts=True)
            return _filled({"kind": pa.array(["pairs"]), "chunk": pa.array([chunk]), "pairs": _lists(pairs, [len(pairs)], pa.int64()), "docs": _lists(docs, [len(docs)], pa.int32())}, 1)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, end in _steps(texts):
                found = [pair.encode(t) for t in texts[start:end]]
                a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                n_a, n_b = (np.array([len(f[k]) for f in found]) for k in (0, 1))
                a_sizes, b_sizes, upto = cut((a, b), pair.lengths)
                # Bytes end where the documents' tokens do; groups up to there, less those before, are a document's own.
                ends = np.cumsum([len(t) + 1 if n else 0 for t, n in zip(texts[start:end], n_a)])
                n_groups = np.diff(upto[ends], prepend=0)
                held.append(_held(a, b, a_sizes, b_sizes, np.repeat(np.arange(end - start), n_groups), pair.sizes))
                n, small = end - start, pa.int32()
                yield _filled({"kind": pa.array(["tokens"] * n), "chunk": pa.array([chunk] * n), "doc_id": ids[start:end], "a": _lists(a, n_a, small), "b": _lists(b, n_b, small)}, n)
                size += int(ends[-1]) + 64 * n
                if size >= CHUNK_BYTES:
                    yield counted()
                    chunk, size, held = chunk + 1, 0, []
        if held:
            yield counted()

    return run


def _spelled(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, names: list[np.ndarray]) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids of every group, in order. ``names``: decimals followed by , | , ; ."""
    after_a, after_b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    out = np.empty(len(a) + len(b), dtype=object)
    out[np.arange(len(a)) + np.repeat(after_b - b_sizes, a_sizes)] = names[0][a]
    out[np.arange(len(b)) + np.repeat(after_a, b_sizes)] = names[0][b]
    out[after_a + after_b - b_sizes - 1] = names[1][a[after_a - 1]]
    out[after_a + after_b - 1] = names[2][b[after_b - 1]]
    return "".join(out.tolist())[:-1]


def _sum_up(lengths):
    """A chunk's tokens and the counts of its pairs to the documents' results."""

    def run(tokens: pa.Table, counts: pa.Table) -> pa.Table:
        if not tokens.num_rows:
            return _RESULT_SCHEMA.empty_table()
        counts = counts.sort_by("pair")
        pairs, count, best = (counts.column(c).to_numpy().astype(np.int64) for c in ("pair", "count", "best"))
        width = len(lengths.value[1])
        decimals = [str(i) for i in range(max(map(len, lengths.value)))]
        names = [np.array([d + mark for d in decimals], dtype=object) for mark in (",", "|", ";")]
        out = []
        for doc_id, *lists in zip(*(tokens.column(c) for c in ("doc_id", "a", "b"))):
            a, b = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            a_sizes, b_sizes, _ = cut((a, b), lengths.value)
            n_best = count_sum = 0
            for _, pair, times in links(a, b, a_sizes, b_sizes, width):
                order = np.argsort(pair)
                at = np.searchsorted(pairs, pair[order])
                n_best += int(best[at] @ times[order])
                count_sum += int(count[at] @ times[order])
            out.append((doc_id.as_py(), len(a), len(b), len(a_sizes), int(a_sizes @ b_sizes), n_best, count_sum, _spelled(a, b, a_sizes, b_sizes, names)))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT_SCHEMA)], schema=_RESULT_SCHEMA)

    return run


def align(docs: DataFrame, a_json: str, b_model: bytes, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row.

    ``a_json`` is a byte-level BPE tokenizer file, which splits texts by ``pattern``; ``b_model`` a
    SentencePiece model that adds a space before the text. A pair's count is the number of documents that
    link it; n_best counts links whose pair no other of the same A id exceeds, count_sum adds up
    the links' counts.
    """
    import sentencepiece

    spark = docs.sparkSession
    text_batches(spark)
    tokens = byte_level_tokens(a_json)
    pieces = piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=b_model))
    by_id = {i: t for t, i in tokens.items()}
    lengths = spark.sparkContext.broadcast([np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)]), np.array(list(map(len, pieces)))])
    shared = spark.sparkContext.broadcast((tokens, b_model))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    aligned = durable_bucketed(texts.mapInArrow(lean(_align(shared, pattern)), _ALIGNED), "aligned", "chunk", "kind")
    listed = aligned.where("kind = 'pairs'").select("chunk", F.explode(F.arrays_zip("pairs", "docs")).alias("held")).select("chunk", F.col("held.pairs").alias("pair"), F.col("held.docs").alias("docs"))
    # A pair has a row a chunk at most, so summing up over its rows where they meet needs no second shuffle.
    total = F.sum("docs").over(Window.partitionBy("pair")).alias("count")
    counted = durable(listed.select("chunk", "pair", total), "pair-counts")
    a_id = F.expr(f"pair div {len(pieces)}")
    most = F.broadcast(counted.groupBy(a_id.alias("a")).agg(F.max("count").alias("most")))
    judged = counted.withColumn("a", a_id).join(most, "a").select(F.col("chunk").alias("of"), "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    kept = aligned.where("kind = 'tokens'").select("chunk", "doc_id", "a", "b")
    return kept.groupBy("chunk").cogroup(judged.groupBy("of")).applyInArrow(_sum_up(lengths), _RESULT)
