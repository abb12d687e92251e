"""The filter audit against DuckDB SQL and brute force, over many ranges and on awkward rows."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest

from quillspark.llm import filter_audit, queries
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
SPACE = "\t\n\v\f\r "


def failures(rows):
    """Brute force: (doc_id, part, letters failed)."""
    out = []
    for doc_id, text, part in rows:
        text = text or ""
        words = "".join(" " if c in SPACE else c for c in text).split(" ")
        words = [w for w in words if w]
        failed = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        failed += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        failed += "E" * any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        out.append((doc_id, part or "", failed))
    return out


def audited(rows, labels):
    """Brute force: every order applied to every document."""
    failed, out = failures(rows), {}
    for part in {p for _, p, _ in failed}:
        mine = [(i, f) for i, p, f in failed if p == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                lost = [sum(max((l[k] == 1 for l in labels if i is not None and l[0] == i and l[k] is not None), default=False) for i, _ in gone) for k in (1, 2)]
                out[part, order, step] = [len(left), len(gone), sum(letter in f for _, f in mine) - len([x for x in mine if letter in x[1] and not set(order[: step - 1]) & set(x[1])]), sum(f == letter for _, f in mine), *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def some_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, 120)), " ".join(["same"] * 150), "LOUD " * 120, " ".join(rng.sample(words, 130)) + " 100%", "short", "", None, "é" * 9 + "A", "é" * 8 + "A", "x\x1cy " * 100]
    rows = [(i, rng.choice(texts[:4]), rng.choice(["en", "fr", None, ""])) for i in range(200)]
    rows += [(1000 + i, texts[1], "en") for i in range(300)]
    rows += [(rng.choice([None, 5, 5, 2000, 2000]), t, "de") for t in texts * 3]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_masks_against_brute_force_over_many_ranges(spark, partitions):
    rows = some_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = filter_audit.failure_masks(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    letters = lambda mask: "".join(c for i, c in enumerate("ABCDE") if mask >> i & 1)
    assert Counter((r["doc_id"], r["part"], letters(r["mask"])) for r in found) == Counter(failures(rows))


def test_carried_texts_pass_over_ranges_of_one_fingerprint():
    a, b = b"a", b"b"
    row = lambda pid, first, last, digest=None, low=None: {"pid": pid, "first_fp": first, "last_fp": last, "digest": digest, "doc_id": low}
    ranges = [row(0, 1, 7), row(0, 1, 7, a, 5), row(1, 7, 7), row(1, 7, 7, b, 3), row(3, 7, 7), row(4, 7, 9), row(4, 7, 9, a, 1), row(5, 9, 9), row(6, 8, 8)]
    assert filter_audit._repeating(ranges) == [(1, a, 5), (3, a, 5), (3, b, 3), (4, a, 5), (4, b, 3), (5, a, 1)]


def test_audit_against_brute_force(spark):
    rows = some_rows()[:60] + some_rows()[-12:]
    labels = [(i, i % 2, i % 3) for i in range(0, 60, 2)] + [(2, 1, 1), (2, 0, 0), (5, None, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, part int, mask int, fp int")
    found = filter_audit.audit(filter_audit.failure_masks(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in found.collect()} == audited(rows, labels)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "x" * 3_000_000, "en"), (0, "x" * 3_000_000, "en")]])
def test_audit_of_awkward_rows(spark, rows):
    found = queries.filter_audit.audit(filter_audit.failure_masks(spark.createDataFrame(rows, "doc_id long, text string, lang string")), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in found.collect()} == audited(rows, [])
    assert found.count() == 600 * len({r[2] for r in rows})
