"""What must not grow faster than the tables: what is shuffled, how often, and by how large groups."""

from __future__ import annotations

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import identifiers
from quillspark.operators import docindex, linkage, records, relational, trusted, vocabulary
from quillspark.plans import registry
from quillspark.sources import contents
from tests.conftest import DATA


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_queries_and_documents_are_summed_where_the_postings_lie(spark):
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("red blue"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("x"), F.col("id"))).alias("title"))
    asked = spark.range(1000, 1040).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("red blue"), F.concat(F.lit("w"), F.col("id") % 7)).alias("text"))
    for fuzzy in (False, True):
        found = linkage.bm25_top_k(asked, docs, k=5, fuzzy=fuzzy)
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan_of(found))
        best = found.where("query_id = 1003 and rank = 1").first()
        assert best["id"] % 7 == 1003 % 7 and found.count() == 200


def test_canonical_forms_name_their_text_once_a_step(spark):
    forms = {kind: identifiers.canonical(kind, F.col("text")) for kind in ("pro_quest", "eric", "open_alex")}
    shown = spark.createDataFrame([("http://https://search.proquest.com/docview/7",)], "text string")
    for form in forms.values():
        assert plan_of(shown.select(form.alias("form"))).count("text#") < 20
    assert shown.select(forms["pro_quest"].alias("f")).first()["f"] == "7"


def test_checks_of_layers_read_a_field_once(spark):
    rows = spark.createDataFrame([('{"source":"s","visibility":"public","content":{"enhancement_type":"abstract","process":"other"}}',)], "line string").select(F.parse_json("line").alias("layer"))
    checked = rows.select(contents.fault(F.col("layer")).alias("fault"))
    assert checked.first()["fault"] == "content.abstract"
    assert checked._jdf.queryExecution().analyzed().toString().count("variant_get(") < 150


def test_components_of_decisions_cost_no_frame_each():
    one = lambda c: [(c, "canonical", 10 * c, "a"), (c, "new", 10 * c + 1, "a"), (c, "new", 10 * c + 2, "b")]
    frame = lambda rows: pd.DataFrame(rows, columns=["component", "kind", "ref", "key"])
    rows = one(1) + one(2) + one(3)
    # A component that goes on in the next frame is one.
    found = list(trusted.decide_each(iter([frame(rows[:4]), frame(rows[4:])])))
    assert len(found) == 1
    told = [(r.reference_id, r.determination, None if pd.isna(r.canonical_id) else r.canonical_id) for r in found[0].itertuples()]
    assert told == [x for c in (1, 2, 3) for x in ((10 * c + 1, "duplicate", 10 * c), (10 * c + 2, "canonical", None))]


def test_an_index_is_written_by_more_tasks_the_more_text_there_is(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(docindex, "CHARS_A_TASK", 2_000, raising=False)
    docs = spark.range(400).select("id", F.concat_ws(" ", F.lit("red"), F.col("id")).alias("title"), F.repeat(F.lit("word "), 10).alias("abstract"))
    index = docindex.DocumentIndex(spark, str(tmp_path / "index"), ["title", "abstract"], n_buckets=1)
    index.sync(docs)
    for part, least in (("documents", 8), ("postings", 16)):
        assert len(list(tmp_path.glob(f"index/segments/*/{part}/**/*.parquet"))) >= least
    assert index.documents().count() == 400 and index.having("title", ["red"]).count() == 400


def test_sets_of_a_record_dont_travel_by_each_of_its_identifiers(spark):
    one = lambda kind, i: F.struct(F.lit(kind).alias("identifier_type"), F.concat(F.lit("k"), i).alias("identifier"))
    i = F.col("reference_id")
    rows = spark.range(60).withColumnRenamed("id", "reference_id").select("reference_id", F.lit("public").alias("visibility"), F.array(one("doi", i % 7), one("eric", i % 5)).alias("identifiers"), F.array().cast("array<string>").alias("fingerprints"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = linkage.exact_duplicates(rows, rows.withColumn("duplicate_determination", F.lit("canonical")))
        todo, dealt = [found._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName() == "Exchange" and "hashpartitioning(key#" in node.simpleString(1000):
                dealt.append(node.output().toString())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert dealt and not any(name in out for out in dealt for name in ("identifiers#", "i2#", "fingerprints#"))
        assert {r["reference_id"]: r["candidate_id"] for r in found.collect()} == {r: r - 35 if r >= 35 else r + 35 for r in range(60) if r >= 35 or r < 25}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shapes_cost_no_row_for_values_that_a_node_lacks(spark):
    v, n = vocabulary, 400
    nodes = spark.range(n).select(F.lit(1).alias("graph"), F.concat(F.lit("f"), "id").alias("s"), F.lit(v.TYPE).alias("p"), F.lit(v.EVIDENCE + "Finding").alias("o"), F.lit(True).alias("iri"))
    held = nodes.where("s <> 'f7'").select("graph", "s", F.lit(v.EVIDENCE + "hasContext").alias("p"), F.lit("x").alias("o"), "iri")
    ontology = spark.createDataFrame([("x", v.TYPE, v.EVIDENCE + "Context")], "s string, p string, o string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = v.shape_violations(nodes.unionByName(held), ontology)
        assert [(r["s"], r["kind"], r["n"]) for r in found.collect()] == [("f7", "or", 1)]
        plan = found._jdf.queryExecution().executedPlan()
        plan.execute().count()
        made, todo = [], [plan]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert made and max(made) <= 4 * n, made
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def joined(plan) -> list[int]:
    """Rows that each join of an executed plan gave."""
    made, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return made


def test_rows_without_a_parent_meet_none(spark):
    # Four of five rows are roots; in each ten, 4 retries 3, 3 retries 2, 2 retries 1.
    i = F.col("id")
    rows = spark.range(400).withColumn("up", F.when((i < 100) & (i % 10).between(2, 4), i - 1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for most in (1, 2, 3, 5):
            found = relational.retry_depths(rows, "id", "up", most)
            assert sorted(map(tuple, found.collect())) == [(n, min(most, n % 10 - 1) if n < 100 and 2 <= n % 10 <= 4 else 0) for n in range(400)]
            assert all(n <= 30 for n in joined(found._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_chains_are_followed_to_their_roots(spark, tmp_path, compare):
    # In each chain of 20 rows 1 retries 0, 2 retries 1 and so on; 500 retries what isn't there.
    i = F.col("id")
    rows = spark.range(200).withColumn("up", F.when(i % 20 > 0, i - 1)).unionByName(spark.createDataFrame([(500, 499)], "id long, up long"))
    assert sorted(map(tuple, relational.retry_depths(rows, "id", "up").collect())) == [*((n, n % 20) for n in range(200)), (500, 1)]
    with pytest.raises(ValueError, match="no end"):
        relational.retry_depths(spark.range(3).withColumn("up", (i + 1) % 3), "id", "up")
    # Seven failures of a user in a row.
    events = spark.range(9).select(i.alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.when(i < 7, "error").otherwise("view").alias("event_type"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "events.parquet").write_bytes(next((tmp_path / "written").glob("part-*.parquet")).read_bytes())
    found = registry.QUERIES["j07_retry_depth"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [*((n, n) for n in range(8)), (8, 0)]


def test_holders_of_an_identifier_are_met_as_their_canonicals(spark):
    # 120 references share a doi: half of them stand for 1, a third for 2, the rest for themselves; 500 is alone.
    refs = [*range(1, 121), 500]
    ids = spark.createDataFrame([(r, "doi", "x" if r < 500 else "y") for r in refs], "reference_id long, identifier_type string, identifier string")
    canonical = {r: 1 if r % 2 else 2 if r % 3 else r for r in range(3, 119)}
    decisions = spark.createDataFrame([(r, True, c) for r, c in canonical.items() if r != c], "reference_id long, active_decision boolean, canonical_reference_id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = linkage.identifier_candidates(ids.withColumn("query_id", F.col("reference_id")), ids, decisions)
        told = {(r["query_id"], r["canonical_id"]) for r in found.collect()}
        made = joined(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    of = lambda r: canonical.get(r, r)
    assert told == {(q, of(r)) for q in refs for r in refs if q != r and q != of(r) and max(q, r) < 500}
    assert max(made) <= len(told) < 120 * 119 / 3


def test_pairs_of_a_frequent_identifier_are_dealt_to_tasks(spark):
    # All 400 share a pm_id, each two a doi; 3 of each ten stand for the one before them.
    refs = spark.range(400).withColumnRenamed("id", "reference_id")
    one = lambda kind, c: refs.select("reference_id", F.lit(kind).alias("identifier_type"), c.cast("string").alias("identifier"))
    ids = one("pm_id", F.lit("x")).unionByName(one("doi", F.expr("reference_id div 2")))
    decisions = refs.where("reference_id % 10 in (1, 4, 7)").select("reference_id", F.lit(True).alias("active_decision"), (F.col("reference_id") - 1).alias("canonical_reference_id"))
    of = lambda r: r - 1 if r % 10 in (1, 4, 7) else r
    want = {}
    for q in range(400):
        for r in range(400):
            if q != r and q != of(r):
                want.setdefault((q, of(r)), set()).update({"pm_id:x"} | ({f"doi:{r // 2}"} if q // 2 == r // 2 else set()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = linkage.identifier_candidates(ids.withColumn("query_id", F.col("reference_id")), ids, decisions, a_task=50).collect()
        met = linkage.identifier_candidates(ids.withColumn("query_id", F.col("reference_id")), ids, decisions, a_task=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in (("adaptive.enabled", None), ("autoBroadcastJoinThreshold", None), ("shuffle.partitions", "4")):
            spark.conf.unset(f"spark.sql.{name}") if value is None else spark.conf.set(f"spark.sql.{name}", value)
    assert {(r["query_id"], r["canonical_id"]): set(r["matched"]) for r in found} == want
    assert re.search(r"hashpartitioning\(identifier_type#\d+, identifier#\d+, row#\d+, column#\d+", met)


def test_candidates_of_orders_use_all_their_identifiers(spark):
    found = registry.QUERIES["d08_identifier_candidates_of_orders"](spark, f"{DATA}/sf0.001")
    orders = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").collect()
    top = {}
    for o in orders:
        key = (o["o_custkey"], o["o_orderpriority"])
        top[key] = min(top.get(key, o["o_orderkey"]), o["o_orderkey"])
    of_status = {}
    for o in orders:
        of_status.setdefault(o["o_orderstatus"], set()).add(top[o["o_custkey"], o["o_orderpriority"]])
    told = {}
    for r in found.collect():
        told.setdefault(r["query_id"], set()).add(r["canonical_id"])
    # Orders of other customers are met by their status.
    assert all(c in told[o["o_orderkey"]] for o in orders[:50] for c in of_status[o["o_orderstatus"]] - {o["o_orderkey"], top[o["o_custkey"], o["o_orderpriority"]]})


def test_annotations_are_ranked_once_and_by_their_rank_alone(spark):
    rows = spark.createDataFrame([(1, "bibliographic", 1, "a", None, 5, "s", True), (1, "annotation", 2, "b", None, 0, "s", False), (2, "abstract", 3, "c", "x", 0, "t", True), (2, "abstract", 3, "d", "y", 0, "u", False)], "reference_id long, enhancement_type string, created_at long, tie string, abstract string, quantity long, scheme string, value boolean")
    notes = rows.select("reference_id", "created_at", "tie", "scheme", F.lit("x").alias("label"), F.lit("boolean").alias("annotation_type"), "value")
    decisions = spark.createDataFrame([(2, True, 1)], "reference_id long, active_decision boolean, canonical_reference_id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = records.search_documents(rows, notes, decisions, ["quantity"])
        assert [tuple(r) for r in found.select("id", "quantity", "abstract", "annotations", "evaluated_schemes").collect()] == [(1, 5, "y", ["t/x"], ["s", "t", "u"])]
        todo, windows = [found._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName() == "Window":
                windows.append(node.output().toString())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(windows) == 1 and "tie#" not in windows[0]
