"""Linkage against brute force on rows that the test tables lack."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.operators import linkage
from quillspark.plans import registry
from tests.conftest import DATA


def test_bm25_of_frequent_words_counts_and_scores(spark, compare):
    rng = random.Random(2)
    common, rare = ["c%d" % i for i in range(4)], ["r%d" % i for i in range(40)]
    docs = [(i, " ".join(rng.sample(common, rng.randint(1, 4)) + rng.sample(rare, rng.randint(0, 3)))) for i in range(60)]
    asked = [(100 + i, " ".join(rng.sample(common, rng.randint(1, 4)) + rng.sample(rare, rng.randint(0, 4)) + ["absent"])) for i in range(30)] + [(None, "c1 c2")]
    want = set()
    for q, text in asked:
        ws = set(text.split())
        want |= {(q, d) for d, title in docs if len(ws & set(title.split())) >= max(1, len(ws) // 2)}
    found = linkage.bm25_top_k(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "id long, title string"), k=1000)
    assert {(r["query_id"], r["id"]) for r in found.collect()} == want
    name = "d06_bm25_top_k"
    compare(registry.QUERIES[name](spark, f"{DATA}/sf0.01"), registry.ORACLE[name], f"{DATA}/sf0.01")


def test_exact_supersets_with_a_hot_identifier(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        kind = i % 3
        ids = {("doi", "hot")} if kind == 0 else {("doi", f"k{rng.randrange(40)}") for _ in range(rng.randint(1, 3))} | ({("other", "o")} if i % 7 == 0 else set())
        if kind == 1 and i % 2:
            ids.add(("doi", "hot"))
        rows.append((i, ["public", "private", None][0 if i % 50 else rng.randrange(3)], sorted(ids), [f"f{rng.randrange(2)}"] if i % 4 else [], rng.choice(["canonical", "duplicate", None])))
    rows.append((1200, "public", [("other", "o")], [], "canonical"))
    want = {}
    for r, v, ids, prints, _ in rows:
        if v and any(k != "other" for k, _ in ids):
            fits = [(0 if d == "canonical" else 2 if d is None else 1, c) for c, w, i2, f2, d in rows if c != r and v == w and set(ids) <= set(i2) and set(prints) <= set(f2)]
            if fits:
                want[r] = min(fits)[1]
    frame = spark.createDataFrame(rows, "reference_id long, visibility string, identifiers array<struct<identifier_type: string, identifier: string>>, fingerprints array<string>, duplicate_determination string")
    found = linkage.exact_duplicates(frame.drop("duplicate_determination"), frame)
    got = found.collect()
    assert {r["reference_id"]: r["candidate_id"] for r in got} == want and len(got) == len(want)


def test_exact_supersets_compare_copies_once(spark):
    n = 600
    rows = [(i, "public", [("doi", "hot")] + ([("doi", f"k{i}")] if i % 2 else []), [], "canonical") for i in range(n)]
    frame = spark.createDataFrame(rows, "reference_id long, visibility string, identifiers array<struct<identifier_type: string, identifier: string>>, fingerprints array<string>, duplicate_determination string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = linkage.exact_duplicates(frame, frame)
        assert found.count() == n // 2
        qe = found._jdf.queryExecution()
        qe.executedPlan().execute().count()
        made, todo = [], [qe.executedPlan()]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        assert made and max(made) < 20 * n, made
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_exact_supersets_of_all_lines(spark, compare):
    name = "d01_exact_supersets"
    compare(registry.QUERIES[name](spark, f"{DATA}/sf0.01"), registry.ORACLE[name], f"{DATA}/sf0.01")


def test_request_pages_go_on_where_they_stopped(spark):
    from quillspark.operators import search, workqueue

    docs = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, kind long")
    asked = search.Query(F.col("kind") == 1)
    none = spark.createDataFrame([(9, 4, "pending", None), (9, 7, "pending", 3)], "request_id int, reference_id long, status string, retry_of long")
    columns = ["request_id", "reference_id", "status", F.lit(None).cast("long").alias("retry_of")]
    first = none.unionByName(workqueue.request_pages(none, docs, asked, 9, 1, "id", 4).where("page <= 2").select(*columns))
    assert workqueue.resume_key(first, 9) == 22 and workqueue.resume_key(first, 8) is None
    rest = workqueue.request_pages(first, docs, asked, 9, 1, "id", 4, after=22)
    assert sorted((r["page"], r["reference_id"]) for r in rest.collect()) == [(1, 25), (1, 28), (1, 31), (1, 34), (2, 37)]
    # What is there already is left out, a retry is no original.
    assert sorted(r["reference_id"] for r in first.where("retry_of is null").collect()) == [1, 4, 7, 10, 13, 16, 19, 22]
    assert {r["reference_id"] for r in workqueue.request_pages(first, docs, asked, 9, 1, "id", 4).collect()} == {25, 28, 31, 34, 37}
