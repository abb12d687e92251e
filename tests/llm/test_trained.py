"""The classifiers on held-out labels, and the pipeline stage by stage against plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, quality, queries, simhash, toxicity
from tests.conftest import DATA
from tests.llm.test_exact import components, reference_fingerprint, similar_lines

SF = f"{DATA}/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def judged(spark, query, label):
    labels = {r["doc_id"]: r[label] for r in queries.table(spark, SF, "labels").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == queries.table(spark, SF, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    return [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op1_quality, "quality", 0.8), (queries.op3_toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, query, label, least):
    rows = judged(spark, query, label)
    ones, zeros = [s for s, _, y in rows if y == 1], [s for s, _, y in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert auc >= least, auc
    assert sum(p == y for _, p, y in rows) / len(rows) >= 0.8


def test_swapping_group_terms_barely_moves_a_score():
    toxic = [f"you {g} are stupid filth number {i}. plain words here" for i in range(40) for g in ("muslims", "christians")]
    clean = [f"the {g} met for dinner number {i}. plain words here" for i in range(40) for g in ("jews", "christians")]
    model = toxicity.fit(toxic + clean, [1] * len(toxic) + [0] * len(clean), 0.5)
    known = toxicity._Weights(model["weights"])
    logit = lambda s: sum(map(known.__getitem__, set(s.split())))
    assert logit("you are stupid filth") > 1
    assert max(abs(logit(f"the {g} met for dinner") - logit("the met for dinner")) for g in ("muslims", "christians", "jews")) < 0.5 * logit("you are stupid filth")


def test_the_penalty_spares_neutral_mentions_of_groups(monkeypatch):
    toxic = [f"you {g} are stupid filth number {i}. plain words here" for i in range(40) for g in ("muslims", "muslims", "christians")]
    clean = [f"the {g} met for dinner number {i}. plain words here" for i in range(40) for g in ("jews", "christians", "christians")]
    neutral = [f"the {g} opened a shop" for g in ("muslims", "christians", "jews", "hindus")]

    def moved():
        model = toxicity.fit(toxic + clean, [1] * len(toxic) + [0] * len(clean), 0.5)
        known = toxicity._Weights(model["weights"])
        logits = [sum(map(known.__getitem__, set(s.split()))) for s in neutral]
        return max(logits) - min(logits)

    with_penalty = moved()
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    without = moved()
    assert with_penalty < 0.1 * without, (with_penalty, without)


@pytest.mark.parametrize("texts", [[], [None, "", "x" * 5000, "a b"]])
@pytest.mark.parametrize("labelled", [[], [(0, None, None), (1, 1, 1)], [(1, 1, 0), (2, 0, 1), (None, 1, 1)]])
def test_few_labels_and_awkward_texts(spark, texts, labelled):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("label", "toxic_score", "quality_score", "kind", "calibrating")})
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).columns.count("toxic_score") == 1
    for made in (quality.classify(docs, labels), toxicity.classify(docs, labels)):
        assert all(0 <= r["score"] <= 1 for r in made.collect()) and made.count() == len(texts)


def test_pipeline_against_plain_python(spark):
    from tokenizers import Tokenizer

    folder = f"{DATA}/sf0.001"
    docs = queries.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    kept = stages["toxicity"](spark, docs, folder)
    scores = {r["doc_id"]: r["score"] for r in queries.op3_toxicity(spark, folder).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    assert {i for i, _ in rows} == {i for i, s in scores.items() if s < 0.3}
    gone = similar_lines(rows)
    rows = [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]
    first = components({i: reference_fingerprint(t) for i, t in rows})
    rows = [(i, t) for i, t in rows if first[i] == i]
    items = [decontaminate.shingles_of(decontaminate.words_of(r["text"])) for r in queries.table(spark, folder, "benchmark").collect()]
    held = lambda t: decontaminate.shingles_of(decontaminate.words_of(t))
    rows = [(i, t) for i, t in rows if not any(s and len(s & held(t)) >= 0.8 * len(s) for s in items)]
    model = Tokenizer.from_file(str(queries.word_tokenizer()))
    model.no_truncation()
    model.no_padding()
    want = {i: hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in model.encode(t or "", add_special_tokens=False).ids)).hexdigest() for i, t in rows}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_stages_take_awkward_documents(spark):
    rows = [(0, None, None, None, None), (None, "", "en", "s", 0), (1, "same line\nsame line", None, None, 19), (1, "same line\nsame line", None, None, 19), (2, "x " * 4000, "en", None, None)]
    for frame in (spark.createDataFrame([], DOCS), spark.createDataFrame(rows, DOCS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, f"{DATA}/sf0.001")
            if name != "bpe":
                assert out.columns == corpus_pipeline.COLUMNS
            out.collect()
    assert simhash.one_of_each(spark.createDataFrame(rows, DOCS)).count() <= 4
