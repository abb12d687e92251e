"""Byte-level BPE through distinct words, against the tokenizer's own library."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

from quillspark.llm import byte_bpe, queries
from tests.conftest import DATA

RANKS = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
AWKWARD = ["", None, " \t\n", "  a\n\n b   c ", "it's 1234 don't", "x" * 40_000, "\x1c\x85\xa0　 z", "日本語のテキスト 한국어 עברית", "🙂👍🏽‍🎉 é", "<|endoftext|> <|startoftext|>", "a\0b", "same words same words " * 3000]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def digests(rows):
    own, out = library(), []
    for doc_id, text in rows:
        ids = own.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest()))
    return Counter(out)


def test_query_against_the_library(spark):
    sf = f"{DATA}/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op13_byte_bpe(spark, sf).collect())) == digests(rows)


@pytest.mark.parametrize("texts", [[], AWKWARD, [None, None, ""]])
def test_awkward_texts(spark, texts):
    rows = [(None if i % 4 == 3 else i // 2, t, 1, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, ids string")
    assert Counter(map(tuple, queries.byte_bpe_digests(docs, RANKS, public_tokenizers.PATTERN).collect())) == digests([r[:2] for r in rows])


def test_chunks_in_one_process(monkeypatch):
    """The steps without Spark: chunks of a few texts, words encoded anew beyond a small bound."""
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 700)
    monkeypatch.setattr(byte_bpe, "KNOWN_WORDS", 5)
    monkeypatch.setattr(byte_bpe.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 3})()))
    rng = random.Random(22)
    rows = [(i, "".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 200))).encode()) for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], names=["doc_id", "text"]) for part in (rows[:25], rows[25:])]
    split = pa.Table.from_batches(byte_bpe._explode(public_tokenizers.PATTERN, 7)(iter(batches)))
    words = split.filter(pa.compute.equal(split["kind"], "words")).select(["chunk", "bucket", "n", "words"]).sort_by("bucket").combine_chunks()
    back = pa.Table.from_batches(byte_bpe._encode_words(type("Shared", (), {"value": RANKS}))(iter(words.to_batches(7))))
    own, found = library(), {}
    chunks = sorted(set(split["chunk"].to_pylist()))
    assert len(chunks) > 5 and chunks[0] == 3 << 24
    for chunk in chunks:
        positions = split.filter(pa.compute.and_(pa.compute.equal(split["kind"], "positions"), pa.compute.equal(split["chunk"], chunk)))
        done = byte_bpe._lay_out(positions, back.filter(pa.compute.equal(back["of"], chunk)))
        found |= dict(zip(done["doc_id"].to_pylist(), done["ids"].to_pylist()))
    assert found == {i: own.encode_ordinary(t.decode()) for i, t in rows}


def test_decoding_leaves_unknown_ids_out(spark):
    rows = [(1, [0, 60_000, 1, -5]), (2, None), (3, [])]
    found = byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), RANKS).orderBy("doc_id").collect()
    by_id = {i: t for t, i in byte_bpe.read_ranks(RANKS).items()}
    assert [bytes(r["bytes"]) for r in found] == [by_id[0] + by_id[1], b"", b""]
