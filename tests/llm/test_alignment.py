"""Token alignment against brute force over byte ranges, with the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quillspark.llm import alignment, queries
from tests.conftest import DATA

AWKWARD = ["", None, "plain words here", "plain words here", " \t\n", "  two  spaces ", "x" * 3000, "日本語のテキスト 한국어 עברית", "🙂👍🏽‍🎉 é ﬁ", "▁not spelled", "<s> </s> <0x0A> <unk>", "<|endoftext|> text", "a\0b", "it's 12345 don't -----=====", " " * 2000, "é́ \x1c\x85 z"]


def aligned(rows):
    """Brute force: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_bytes = {i: t for t, i in alignment.byte_level_tokens(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()).items()}
    b_bytes = alignment.piece_bytes(b_model)
    docs = []
    for doc_id, text in rows:
        groups, wanted = [], b" " + (text or "").encode()
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            if b"".join(a_bytes.get(i, b"") for i in a) == wanted == b"".join(b_bytes[i] for i in b):
                i = j = at_a = at_b = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        group[0].append(a[i])
                        at_a, i = at_a + len(a_bytes[a[i]]), i + 1
                    else:
                        group[1].append(b[j])
                        at_b, j = at_b + len(b_bytes[b[j]]), j + 1
                    if at_a == at_b:
                        groups.append(group)
                        group = ([], [])
        docs.append((doc_id, groups))
    holds = Counter(p for _, groups in docs for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, groups in docs:
        pairs = [(x, y) for g in groups for x in g[0] for y in g[1]]
        spelled = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs), sum(holds[p] == most[p[0]] for p in pairs), sum(holds[p] for p in pairs), hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return Counter(out)


def test_query_against_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.op12_alignment(spark, sf).collect())) == aligned(rows)


@pytest.mark.parametrize("texts", [[], AWKWARD, [None, "", None]])
def test_awkward_texts_over_chunks(spark, texts):
    rows = [(None if i % 4 == 3 else i // 2, t, 1, "c") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, groups string").repartition(5)
    assert Counter(map(tuple, queries.alignment_digests(docs).collect())) == aligned([r[:2] for r in rows])


def test_links_of_large_groups_and_pieces_are_those_of_each_pair(monkeypatch):
    rng = np.random.default_rng(4)
    for bound in (0, 5, 1 << 16):
        monkeypatch.setattr(alignment, "MANY_LINKS", bound)
        a_sizes, b_sizes = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
        a, b = rng.integers(0, 4, a_sizes.sum()), rng.integers(0, 4, b_sizes.sum())
        found = Counter()
        for group, pair, times in alignment.links(a, b, a_sizes, b_sizes, 10):
            for g, p, n in zip(group.tolist(), pair.tolist(), times.tolist()):
                found[g, p] += n
        i, j, wanted = 0, 0, Counter()
        for g, (m, n) in enumerate(zip(a_sizes, b_sizes)):
            wanted.update((g, int(x * 10 + y)) for x in a[i : i + m] for y in b[j : j + n])
            i, j = i + m, j + n
        assert found == wanted


def test_a_long_text_is_encoded_as_a_short_one(monkeypatch):
    tokens = alignment.byte_level_tokens(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    pair = alignment._Pair(tokens, Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes(), public_tokenizers.PATTERN)
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab  \n'sé1.日") for _ in range(500)).encode() for _ in range(50)]
    short = [pair.encode(t) for t in texts]
    monkeypatch.setattr(alignment, "LONG_TEXT", 1)
    assert all((x == y).all() for t, s in zip(texts, short) for x, y in zip(pair.encode(t), s))
    assert len(pair.encode(b" " * 1_500_000)[0]) and len(pair.encode(("word " * 300_000).encode())[1])
