"""Functions, sources and streams on rows that the test tables lack."""

from __future__ import annotations

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.functions import identifiers, text
from quillspark.operators import linkage, records, relational, search, standing, vocabulary, workqueue
from quillspark.sources import lines, sinks
from quillspark.streaming import ingest


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(column(F.col("x"))).collect()]


def test_newlines_and_mojibake(spark):
    assert values(spark, text.escape_newlines, ["a b\x85c ", "a\nb", None]) == ["a\\nb\\nc\\n", "a\nb", None]
    wrong = "cafÃ© – Ã".replace("–", "-")
    assert values(spark, text.demojibake, ["cafÃ©", "café", "Ã", "日本", None, wrong]) == ["café", "café", "Ã", "日本", None, wrong]
    frame = spark.createDataFrame([("cafÃ©", ["Ã©a", "b"], 1)], "title string, authors array<string>, abstract int")
    assert text.demojibake_fields(frame).first() == ("café", ["éa", "b"], 1)
    listed = json.dumps({"name": ["Ã©", ["Ã©"], {"x": "Ã©", "name": "Ã©"}], "x": ["Ã©"]})
    assert json.loads(values(spark, text.demojibake_json, [listed])[0]) == {"name": ["é", ["é"], {"x": "Ã©", "name": "é"}], "x": ["Ã©"]}
    nested = json.dumps({"name": "Ã©", "other": "Ã©", "x": [{"@value": "Ã©", "description": 3}]})
    got = values(spark, text.demojibake_json, [nested, "no json", None])
    assert json.loads(got[0]) == {"name": "é", "other": "Ã©", "x": [{"@value": "é", "description": 3}]} and got[1:] == ["no json", None]


def test_tags_samples_and_years(spark):
    assert [tuple(r) for r in values(spark, text.parse_tag, ["s/l@0.123456", "s/l/m@1", "s", "s/l@x@y"])] == [("s", "l", 0.123456), ("s", "l/m", 1.0), ("s", None, None), ("s", "l", None)]
    keys = [str(uuid.UUID(int=i)) for i in range(200)]
    want = [int.from_bytes(hashlib.blake2b(uuid.UUID(k).bytes).digest(), "big") % 8 == 0 for k in keys]
    assert values(spark, lambda c: text.sampled(c, 3), keys) == want and any(want) and not any(values(spark, lambda c: text.sampled(c, None), keys))


def test_identifiers(spark):
    dois = ["https://DX.doi.org/10.1000/ab c", "doi: 10.1000/éx", "10.1000/a‐b\xa0", "10.1/x", None]
    assert values(spark, identifiers.canonical_doi, dois) == [None, "10.1000/éx", "10.1000/a-b", None, None]
    assert values(spark, lambda c: identifiers.canonical("pm_id", c), ["12", "0", "-3", "x"]) == ["12", None, None, None]
    lookups = ["3f1c9a52-0000-0000-0000-000000000000", "doi:10.1/a:b", "other:isbn:9:7"]
    read = spark.createDataFrame([(x,) for x in lookups], "x string").select(identifiers.parse_lookup(F.col("x")).alias("l"), "x")
    back = read.select("l.*", identifiers.format_lookup(F.col("l.identifier_type"), F.col("l.identifier"), F.col("l.other_identifier_name")).alias("x")).collect()
    assert [tuple(r) for r in back] == [("id", None, lookups[0], lookups[0]), ("doi", None, "10.1/a:b", lookups[1]), ("other", "isbn", "9:7", lookups[2])]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rows = [json.dumps({"identifiers": [{"identifier": f"10.1000/{i}", "identifier_type": "doi"}]}) if i % 3 else "" for i in range(400)]
    (tmp_path / "in.jsonl").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lines.read_lines(spark, str(tmp_path / "in.jsonl"))
        assert {r["line_no"]: r["line"] for r in got.collect()} == {i + 1: r for i, r in enumerate(rows) if r}
        parsed = lines.parse_references(got)
        assert {r["status"] for r in parsed.collect()} == {"ok"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hosts():
    assert lines.allowed_url("https://a.example.org/x", ["example.org"]) and not lines.allowed_url("https://badexample.org", ["example.org"]) and lines.allowed_url("http://x", ["y"], local=True)


def test_a_stream_of_lines_is_parsed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = json.dumps({"identifiers": [{"identifier": "10.1000/a", "identifier_type": "doi"}]})
    seen = []

    def sink(batch, _):
        seen.extend((r["status"], r["result"]) for r in batch.withColumn("result", ingest.import_result(F.col("status"), F.col("errors"))).select("status", "result").collect())

    for name, body in (("a", good + "\n\nnot json\n"), ("b", good.replace("/a", "/b") + "\n")):
        (tmp_path / "in" / f"{name}.jsonl").write_text(body)
        ingest.stream_references(spark, str(tmp_path / "in"), str(tmp_path / "done"), sink).awaitTermination(120)
    assert sorted(seen) == [("failed", "failed"), ("ok", "completed"), ("ok", "completed")]


def test_closures_of_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)], "low string, high string")
    assert vocabulary.closure(chain).count() == 201 * 200 // 2
    assert vocabulary.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "low string, high string")).count() == 4


def test_ranks_and_refusals(spark):
    frame = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("key"))
    assert {r["key"]: (r["rank_"], r["total_"]) for r in relational.exact_rank(frame, "key").collect()} == {i: (i + 1, 5000) for i in range(5000)}
    assert relational.exact_rank(frame.limit(0), "key").count() == 0
    with pytest.raises(KeyError):
        relational.verify_all(frame.limit(2), frame.limit(0), "key")
    with pytest.raises(ValueError):
        relational.merge_known(frame.limit(1), frame.where("key = 4999"), "key")
    with pytest.raises(ValueError):
        linkage.CandidateSearch(linkage.POLICIES["candidate_selection_v1"], k=1001)
    with pytest.raises(ValueError):
        workqueue.lease(frame, frame, F.now(), 0)
    with pytest.raises(ValueError):
        search.search(frame, search.Query(), page=501)


def test_words_that_are_near(spark):
    frame = spark.createDataFrame([("climate",), ("cilmate",), ("climates",), ("clmiaet",), ("clmaites",), (None,)], "t string")
    assert [r[0] for r in frame.where(search.fuzzy("t", "climate", 1)).collect()] == ["climate", "cilmate", "climates"]
    assert [r[0] for r in frame.where(search.fuzzy("t", "climate")).collect()] == ["climate", "cilmate", "climates", "clmiaet"]
    assert [r[0] for r in frame.where(search.fuzzy("t", "climate", 0)).collect()] == ["climate"]


def test_layers_and_standing_queries(spark):
    made = spark.sql("SELECT array(named_struct('enhancement_type', 'full_text', 'label', 'a', 'value', true), named_struct('enhancement_type', 'abstract', 'label', 'b', 'value', false)) AS e")
    one = lambda c: made.select(c).first()[0]
    assert len(one(sinks.redacted(F.col("e"), False))) == 1 and len(one(sinks.redacted(F.col("e"), True))) == 2
    both = lambda x: (x["label"] == "a") & x["value"]
    assert one(standing.element(F.col("e"), both)) and not one(standing.element(F.col("e"), lambda x: (x["label"] == "b") & x["value"]))
    assert not one(standing.none_of(standing.element(F.col("e"), both)))
    assert abs(one(linkage.dis_max(F.array(F.lit(1.0), F.lit(2.0)))) - 2.1) < 1e-9
    names = spark.sql("SELECT array(named_struct('display_name', 'Z', 'position', 'last'), named_struct('display_name', 'B', 'position', 'middle'), named_struct('display_name', 'A', 'position', 'middle'), named_struct('display_name', 'Q', 'position', 'first')) AS a")
    assert names.select(records.ordered_authors(F.col("a"))).first()[0] == ["Q", "A", "B", "Z"]
    assert [r[0] for r in spark.createDataFrame([(["Anna-Maria O'Neil", "李", "x"],)], "a array<string>").select(text.author_terms(F.col("a"))).collect()] == [["Anna Maria Neil", "李"]]


def test_stored_payloads_and_lines(spark, tmp_path):
    frame = spark.createDataFrame([("k1", 1, None), ("k2", 2, "x y")], "k string, n int, t string")
    sinks.write_payloads(frame, "k", str(tmp_path / "p"))
    assert {r["k"]: json.loads(r["payload"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"k1": {"n": 1}, "k2": {"n": 2, "t": "x y"}}
    sinks.export_lines(frame, sinks.json_line("k", "t"), str(tmp_path / "l"))
    assert sorted(json.loads(r[0])["k"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["k1", "k2"]
