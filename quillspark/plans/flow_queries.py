"""Registered queries of stores, projections, candidates, imports and linked data, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import identifiers, text
from quillspark.operators import decisions, lineage, linkage, nearwords, records, relational, search, vocabulary, workqueue
from quillspark.plans import corpus
from quillspark.plans.record_queries import ORACLE, QUERIES
from quillspark.plans.search_queries import TOKENS, query
from quillspark.sources import lines as source_lines
from quillspark.sources import sinks
from quillspark.streaming import ingest

__all__ = ["ORACLE", "QUERIES"]


def _table(name: str):
    return lambda spark, sf_dir: corpus.table(spark, sf_dir, name)


orders, lineitem, part, customer, nation, events, pages, supplier = map(_table, ("orders", "lineitem", "part", "customer", "nation", "events", "pages", "supplier"))


@query("src07_by_pk", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def by_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.find(orders(spark, sf_dir), o_orderkey=77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("src10_pk_range", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def pk_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).where(search.between("o_orderkey", 100, 900)).select("o_orderkey")


@query("src12_imported_references", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def imported_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = relational.find(events(spark, sf_dir), event_type="purchase").select("user_id")
    return relational.any_of(customer(spark, sf_dir), "c_custkey", done).select("c_custkey", "c_name")


@query("f17_results_by_status", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id = 7 ORDER BY event_id")
def results_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.find(events(spark, sf_dir), "event_id", event_type="error", user_id=7).select("event_id", "user_id")


@query("snk05_add_bulk", "SELECT k, count(*) AS n, count(price) AS priced FROM (SELECT o_custkey AS k, o_totalprice AS price FROM orders UNION ALL SELECT c_custkey, NULL FROM customer) GROUP BY k")
def add_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = orders(spark, sf_dir).select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"))
    both = relational.add_bulk(there, customer(spark, sf_dir).select(F.col("c_custkey").alias("k")))
    return both.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"))


@query("snk07_add_or_find", """WITH new AS (SELECT l_partkey AS k, max(l_linenumber) AS v FROM lineitem GROUP BY 1), old AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size > 10)
  SELECT new.k, coalesce(old.v, new.v) AS v FROM new LEFT JOIN old ON old.k = new.k""")
def add_or_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = part(spark, sf_dir).where("p_size > 10").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"))
    new = lineitem(spark, sf_dir).groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_linenumber").cast("long").alias("v"))
    return relational.add_or_find(old, new, "k")


@query("snk09_update_nulls", f"WITH {corpus.LAYERS_SQL} SELECT reference_id, number, coalesce(note, 'none') AS note FROM layers")
def update_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.line_enhancements(spark, sf_dir).select("reference_id", "number", "note")
    return relational.bulk_update(rows, relational.same("note", None), note="none")


@query("snk10_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = customer(spark, sf_dir).where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.delete(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("snk11_merge_known", """SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier""")
def merge_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = supplier(spark, sf_dir).select("s_suppkey", "s_name", "s_nationkey")
    changed = there.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("secret").alias("s_name"), (F.col("s_nationkey") + 1).cast(there.schema["s_nationkey"].dataType).alias("s_nationkey"))
    return relational.merge_known(there, changed, "s_suppkey", kept=("s_name",))


def _score_sql(words: list[str]) -> str:
    """Scores of refs, as the best BM25 sum over title and abstract."""
    cols, sums = [], []
    for c in ("title", "abstract"):
        for i, w in enumerate(words):
            cols.append(f"len(list_filter({c}_w, lambda t: t = '{w}')) AS {c}_{i}")
        sums.append(" + ".join(f"coalesce(ln(1 + (n_docs - {c}_{i}_df + 0.5) / ({c}_{i}_df + 0.5)) * {c}_{i} * 2.2 / ({c}_{i} + 1.2 * (0.25 + 0.75 * len({c}_w) / {c}_avg)), 0)" for i in range(len(words))))
    dfs = ", ".join(f"count_if({c}_{i} > 0) AS {c}_{i}_df" for c in ("title", "abstract") for i in range(len(words)))
    return f"""ws AS (SELECT *, {TOKENS.format('title')} AS title_w, {TOKENS.format('abstract')} AS abstract_w FROM refs), tf AS (SELECT *, {', '.join(cols)} FROM ws),
      st AS (SELECT count(*) AS n_docs, avg(len(title_w)) AS title_avg, avg(len(abstract_w)) AS abstract_avg, {dfs} FROM tf),
      scored AS (SELECT id, lang, round(greatest({', '.join(sums)}), 6) AS score FROM tf, st)"""


@query("q02_scored_query", f"WITH {corpus.REFS_SQL}, {_score_sql(['thation', 'onin'])} SELECT id, score FROM scored WHERE score > 0 AND lang = 'en'")
def scored_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.scored(corpus.document_refs(spark, sf_dir), "thation onin", ["title", "abstract"])
    asked = search.Query(F.col("score_") > 0, (("lang", F.col("lang") == "en"),))
    return found.where(asked.predicate()).select("id", F.col("score_").alias("score"))


@query("q07_relevance", f"WITH {corpus.REFS_SQL}, {_score_sql(['this', 'onin'])} SELECT id, score FROM scored WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 20")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.scored(corpus.document_refs(spark, sf_dir), "this onin", ["title", "abstract"])
    return search.search(found, search.Query(F.col("score_") > 0), ["relevance"]).select("id", F.col("score_").alias("score"))


@query("q07_relevance_ascending", f"WITH {corpus.REFS_SQL}, {_score_sql(['this'])} SELECT id, score FROM scored WHERE score > 0 ORDER BY score, id DESC LIMIT 20")
def relevance_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.scored(corpus.document_refs(spark, sf_dir), "this", ["title", "abstract"])
    return search.search(found, search.Query(F.col("score_") > 0), ["-relevance"]).select("id", F.col("score_").alias("score"))


@query("q09_search_ids", "SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders WHERE o_orderstatus = 'F' QUALIFY place <= 10000")
def search_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    return search.search_ids(docs, search.Query(F.col("o_orderstatus") == "F"), ["-o_totalprice"])


@query("q10_two_stage", """WITH hits AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders QUALIFY r <= 20)
  SELECT id, CAST(r AS INTEGER) AS rank, count(l_orderkey) AS n_lines, sum(l_quantity) AS quantity FROM hits LEFT JOIN lineitem ON l_orderkey = id GROUP BY id, r HAVING count(l_orderkey) > 0""")
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "o_totalprice")
    hits = search.search(docs, search.Query(), ["-o_totalprice"])
    whole = lineitem(spark, sf_dir).groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    return search.hydrate(hits, whole, "id", [F.desc("o_totalprice"), F.desc("id")]).select("id", "rank", "n_lines", "quantity")


@query("f14_hydrated", f"""WITH {corpus.LAYERS_SQL}, {corpus.IDENTIFIERS_SQL}
  SELECT reference_id, (SELECT count(*) FROM layers l WHERE l.reference_id = r.reference_id AND enhancement_type IN ('abstract', 'annotation')) AS n_layers,
    (SELECT count(*) FROM identifiers i WHERE i.reference_id = r.reference_id AND identifier_type = 'doi') AS n_dois FROM (SELECT DISTINCT reference_id FROM identifiers) r""")
def hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus.page_identifiers(spark, sf_dir)
    whole = records.hydrated(ids.select("reference_id"), corpus.line_enhancements(spark, sf_dir).select("reference_id", "number", "enhancement_type"), ids, ("abstract", "annotation"), ("doi",))
    return whole.select("reference_id", F.size("enhancements").cast("long").alias("n_layers"), F.size("identifiers").cast("long").alias("n_dois"))


@query("f15_canonical_flags", f"""WITH {corpus.DECISIONS_SQL}, r AS (SELECT c_custkey AS reference_id, duplicate_determination AS d FROM customer LEFT JOIN decisions ON reference_id = c_custkey)
  SELECT d = 'canonical' AS canonical, coalesce(d <> 'duplicate', true) AS canonical_like, count(*) AS n FROM r GROUP BY ALL""")
def canonical_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = customer(spark, sf_dir).select(F.col("c_custkey").alias("reference_id")).join(corpus.order_decisions(spark, sf_dir), "reference_id", "left")
    det = F.col("duplicate_determination")
    return found.groupBy(records.is_canonical(det).alias("canonical"), records.canonical_like(det).alias("canonical_like")).agg(F.count(F.lit(1)).alias("n"))


@query("f16_looked_up", f"""WITH {corpus.DECISIONS_SQL}, {corpus.IDENTIFIERS_SQL}, ids AS (SELECT DISTINCT reference_id FROM identifiers WHERE identifier_type = 'doi' UNION SELECT n_nationkey FROM nation)
  SELECT DISTINCT coalesce(canonical_reference_id, ids.reference_id) AS canonical_id FROM ids LEFT JOIN decisions USING (reference_id)""")
def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus.page_identifiers(spark, sf_dir)
    found = linkage.find_by_identifiers(ids, ids.where("identifier_type = 'doi'"))
    return records.looked_up(found, nation(spark, sf_dir).select(F.col("n_nationkey").cast("long").alias("reference_id")), corpus.order_decisions(spark, sf_dir))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("raw", "full_text", "abstract", "linked_data", "bibliographic", "annotation", "reference_association"))), F.col("l_linenumber").cast("int"))
    return lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("enhancement_type"), "l_partkey")).alias("enhancements"))


_KINDS_SQL = "list_value('raw', 'full_text', 'abstract', 'linked_data', 'bibliographic', 'annotation', 'reference_association')[l_linenumber]"


@query("f18_redacted", f"SELECT l_orderkey, count_if({_KINDS_SQL} <> 'full_text') AS n, count(*) AS entitled FROM lineitem GROUP BY l_orderkey")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda entitled: F.size(sinks.redacted(F.col("enhancements"), entitled)).cast("long")
    return _kinds(spark, sf_dir).select("l_orderkey", n(False).alias("n"), n(True).alias("entitled"))


@query("f19_searchable_layers", f"SELECT l_orderkey, count_if({_KINDS_SQL} NOT IN ('raw', 'linked_data', 'reference_association')) AS n FROM lineitem GROUP BY l_orderkey")
def searchable_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).select("l_orderkey", F.size(records.searchable_layers(F.col("enhancements"))).cast("long").alias("n"))


@query("j12_vocabulary", """SELECT n_name AS concept, 'label of ' || n_name AS label, r_name AS scheme FROM nation JOIN region ON n_regionkey = r_regionkey""")
def vocabulary_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = _nation_triples(spark, sf_dir)
    return vocabulary.labels(triples).join(vocabulary.schemes(triples), "concept")


def _nation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = nation(spark, sf_dir).join(corpus.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda s, p, o: there.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    name, region = F.col("n_name"), F.col("r_name")
    return row(name, vocabulary.PREF_LABEL, F.concat(F.lit("label of "), name)).unionByName(row(name, vocabulary.IN_SCHEME, region)).unionByName(row(name, vocabulary.TYPE, F.concat(F.lit("class "), region)))


@query("v08_scheme_members", "SELECT r_name AS scheme, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def scheme_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.members(_nation_triples(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary: regions are schemes of nations, with properties of each kind and some that only look like one.

    The last region's annotation class is no coding annotation; every even one has a second restriction; the second
    and third regions' classes lie below the class of concepts.
    """
    v, regions, key = vocabulary, corpus.table(spark, sf_dir, "region"), F.col("r_regionkey")
    row = lambda s, p, o, where="true": regions.where(where).select((F.concat(F.lit(s), "r_name") if s else F.col("r_name")).alias("s"), F.lit(p).alias("p"), o.alias("o"))
    of = lambda text: F.concat(F.lit(text), "r_name")
    rows = [
        row("property ", v.TYPE, F.lit(v.OBJECT_PROPERTY)),
        row("property ", v.RANGE, of("annotation ")),
        row("annotation ", v.SUB_CLASS_OF, F.when(key < 4, v.CODING_ANNOTATION).otherwise("something")),
        row("annotation ", v.SUB_CLASS_OF, of("node ")),
        row("node ", v.ON_PROPERTY, F.lit(v.CODED_VALUE)),
        row("node ", v.ALL_VALUES_FROM, of("class ")),
        row("annotation ", v.SUB_CLASS_OF, of("other node "), "r_regionkey % 2 = 0"),
        row("other node ", v.ON_PROPERTY, F.lit("other value"), "r_regionkey % 2 = 0"),
        row("other node ", v.ALL_VALUES_FROM, F.lit("class of nothing"), "r_regionkey % 2 = 0"),
        row("", v.TYPE, F.lit(v.CONCEPT_SCHEME), "r_regionkey = 0"),
        row("direct ", v.RANGE, F.col("r_name")),
        row("direct ", v.TYPE, F.lit(v.OBJECT_PROPERTY)),
        row("class ", v.SUB_CLASS_OF, F.lit("class in between"), "r_regionkey IN (1, 2)"),
        row("below ", v.RANGE, of("class ")),
        row("below ", v.TYPE, F.lit(v.OBJECT_PROPERTY), "r_regionkey < 2"),
        row("bare ", v.RANGE, F.lit(v.CONCEPT), "r_regionkey = 3"),
        row("bare ", v.TYPE, F.lit(v.OBJECT_PROPERTY), "r_regionkey = 3"),
        row("class in between", v.SUB_CLASS_OF, F.lit(v.CONCEPT), "r_regionkey = 0").withColumn("s", F.lit("class in between")),
        nation(spark, sf_dir).select(F.col("n_name").alias("s"), F.lit(v.TYPE).alias("p"), F.lit(v.CONCEPT).alias("o")),
    ]
    out = _nation_triples(spark, sf_dir)
    for r in rows:
        out = out.unionByName(r)
    return out


@query("v05_scheme_properties", "SELECT r_name AS scheme, 'property ' || r_name AS property FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) AND r_regionkey < 4")
def scheme_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.properties(_vocabulary(spark, sf_dir))


@query("v06_unwrapped_properties", "SELECT CASE r_regionkey WHEN 0 THEN 'direct ' WHEN 1 THEN 'below ' WHEN 3 THEN 'bare ' END || r_name AS property FROM region WHERE r_regionkey IN (0, 1, 3)")
def unwrapped_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.unwrapped_properties(_vocabulary(spark, sf_dir))


@query("v04_discovered_concepts", """WITH c AS (SELECT c_custkey, n_name, r_name, r_regionkey, c_custkey % 10 <> 0 AS valid, c_custkey % 4 = 0 AS bare, (SELECT r_name FROM region WHERE r_regionkey = 0) AS first FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
  SELECT c_custkey AS reference_id, CASE WHEN bare OR (valid AND c_custkey % 3 <> 1) THEN n_name ELSE '' END AS concepts, CASE WHEN bare OR (valid AND c_custkey % 3 <> 1) THEN 'label of ' || n_name ELSE '' END AS labels,
    concat_ws(',', CASE WHEN bare THEN 'direct ' || first END, CASE WHEN valid AND r_regionkey < 4 THEN 'property ' || r_name END) AS evaluated FROM c""")
def discovered_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = customer(spark, sf_dir).join(nation(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.broadcast(corpus.table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.concat(F.lit("direct "), "r_name").alias("first")))
    status = F.when(key % 3 == 0, "coded").when(key % 3 == 1, "not_coded")
    wrapped = F.struct(status.alias("status"), F.struct(F.when(key % 10 == 0, "nowhere").otherwise(F.col("n_name")).alias("@id")).alias("value"))
    alone = F.to_json(F.struct(F.col("n_name").alias("@id")))
    whole = F.concat(F.lit('{"topic":'), F.to_json(wrapped), F.lit(',"'), F.when(key % 4 == 0, F.col("first")).otherwise("unknown"), F.lit('":'), alone, F.lit("}"))
    values = vocabulary.coded_rows(rows.join(first).select(key.alias("reference_id"), whole.alias("data")))
    found = vocabulary.project_discovered(values, _vocabulary(spark, sf_dir))
    return found.select("reference_id", *(F.array_join(c, ",").alias(c) for c in ("concepts", "labels", "evaluated")))


@query("v07_shape_violations", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
  SELECT c AS graph, 'f' || k AS s, NULL AS path, 'or' AS kind, 1 AS n FROM o WHERE k % 4 = 0 UNION ALL
  SELECT c, 'f' || k, 'hasContext', 'class', 1 FROM o WHERE k % 4 <> 0 AND k % 3 = 0 UNION ALL
  SELECT c, 'i' || c, 'hasFinding', 'class', count(*) FROM o WHERE k % 7 = 0 GROUP BY c UNION ALL
  SELECT c, 'i' || c, 'hasAppliedConcept', 'nodeKind', count(*) FROM o WHERE k % 5 = 0 GROUP BY c UNION ALL
  SELECT c, 'i' || c, 'hasAppliedConcept', 'class', count(*) FROM o WHERE k % 5 = 0 GROUP BY c UNION ALL
  SELECT DISTINCT c, 'e' || c, 'hasInvestigation', 'minCount', 1 FROM o WHERE c % 2 = 1""")
def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as findings of one investigation, with faults of every kind."""
    v, rows = vocabulary, orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    row = lambda where, s, p, o, iri=True: rows.where(where).select(F.col("c").alias("graph"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(iri).alias("iri"))
    e = v.EVIDENCE
    parts = [
        row("true", name("f", "k"), v.TYPE, F.lit(e + "Finding")),
        row("k % 4 <> 0", name("f", "k"), e + "hasContext", name("x", "k")),
        row("k % 3 <> 0", name("x", "k"), v.TYPE, F.lit("special context")),
        row("true", name("i", "c"), v.TYPE, F.lit(e + "Investigation")),
        row("true", name("i", "c"), e + "hasFinding", F.when(F.col("k") % 7 == 0, name("g", "k")).otherwise(name("f", "k"))),
        row("k % 5 = 0", name("i", "c"), e + "hasAppliedConcept", name("text ", "k"), False),
        row("k % 5 <> 0", name("i", "c"), e + "hasAppliedConcept", F.lit("a concept")),
        row("true", name("e", "c"), v.TYPE, F.lit(e + "LinkedDataEnhancement")),
        row("c % 2 = 0", name("e", "c"), e + "hasInvestigation", name("i", "c")),
    ]
    data = parts[0]
    for p in parts[1:]:
        data = data.unionByName(p)
    ontology = spark.createDataFrame([("special context", v.SUB_CLASS_OF, e + "Context"), ("a concept", v.TYPE, "kind of concept"), ("kind of concept", v.SUB_CLASS_OF, v.CONCEPT)], "s string, p string, o string")
    return v.shape_violations(data, ontology)


@query("v07_violations", "SELECT s_name AS s, p FROM supplier, (VALUES ('name'), ('balance')) t(p) WHERE p = 'balance' AND s_nationkey % 2 = 1")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supplier(spark, sf_dir).select(F.col("s_name").alias("s"), "s_nationkey")
    triples = rows.select("s", F.lit("name").alias("p"), F.lit("x").alias("o")).unionByName(rows.where("s_nationkey % 2 = 0").select("s", F.lit("balance").alias("p"), F.lit("y").alias("o")))
    return vocabulary.violations(rows.select("s"), triples, ["name", "balance"])


def _linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON text of linked data for each nation: coded, uncoded and bare concepts, and countries."""
    of = F.struct(F.col("n_name").alias("@id"))
    status = F.when(F.col("n_nationkey") % 3 == 0, "coded").when(F.col("n_nationkey") % 3 == 1, "not_coded")
    topic = F.struct(status.alias("status"), of.alias("value"))
    code = F.struct(F.lit("coded").alias("status"), F.struct(F.concat(F.lit(" c"), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("@value")).alias("value"))
    bare = F.array(F.struct(F.concat(F.lit("bare "), "n_name").alias("@id")))
    return nation(spark, sf_dir).select(F.col("n_nationkey").alias("reference_id"), F.to_json(F.struct(topic.alias("topic"), code.alias("place"), bare.alias("kind"), F.lit("plain").alias("note"))).alias("data"))


@query("v01_linked_data", """SELECT n_nationkey AS reference_id, CASE WHEN n_nationkey % 3 = 1 THEN '' ELSE n_name || ',' END || 'bare ' || n_name AS concepts,
  CASE WHEN n_nationkey % 3 <> 1 THEN 'label of ' || n_name END AS labels, 'kind,note,place,topic' AS evaluated FROM nation""")
def linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vocabulary.coded_rows(_linked_data(spark, sf_dir))
    found = vocabulary.project(coded, _nation_triples(spark, sf_dir))
    joined = lambda c: F.array_join(F.array_sort(c, lambda a, b: F.when(a.startswith("bare"), F.when(b.startswith("bare"), 0).otherwise(1)).when(b.startswith("bare"), -1).otherwise(0)), ",")
    return found.select("reference_id", joined("concepts").alias("concepts"), F.nullif(F.array_join("labels", ","), F.lit("")).alias("labels"), F.array_join("evaluated", ",").alias("evaluated"))


@query("v03_countries", "SELECT n_nationkey AS reference_id, 'C' || n_regionkey AS countries FROM nation")
def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.countries(vocabulary.coded_rows(_linked_data(spark, sf_dir)), ["place", "note_"]).withColumn("countries", F.array_join("countries", ","))


@query("x24_regions", """SELECT l_orderkey AS reference_id, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS regions FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_name <> 'NATION_3' GROUP BY 1""")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = supplier(spark, sf_dir).join(nation(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    lists = lineitem(spark, sf_dir).join(named, "l_suppkey").groupBy(F.col("l_orderkey").alias("reference_id")).agg(F.collect_set("n_name").alias("countries"))
    map_ = nation(spark, sf_dir).where("n_name <> 'NATION_3'").join(corpus.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    return vocabulary.regions_of(lists, map_).withColumn("regions", F.array_join("regions", ","))


@query("j13_changesets", f"WITH {corpus.DECISIONS_SQL} SELECT e.event_id, e.user_id AS changed_id, coalesce(canonical_reference_id, e.user_id) AS canonical_id, o_totalprice AS price FROM events e LEFT JOIN decisions ON reference_id = e.user_id JOIN orders ON o_orderkey = coalesce(canonical_reference_id, e.user_id)")
def changesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = events(spark, sf_dir).select("event_id", F.col("user_id").cast("long").alias("reference_id"))
    references = orders(spark, sf_dir).select(F.col("o_orderkey").alias("reference_id"), F.col("o_totalprice").alias("price"))
    return records.canonical_with_changes(changes, references, corpus.order_decisions(spark, sf_dir)).select("event_id", "changed_id", "canonical_id", "price")


_RESULTS_SQL = "results AS (SELECT user_id AS batch, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partially_failed' WHEN 'signup' THEN 'created' ELSE 'completed' END AS status, 'at ' || event_id AS failure_details FROM events)"


@query("a11_batch_summary", f"""WITH {_RESULTS_SQL} SELECT batch, count(*) AS total, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(status = 'created') AS created, 0::BIGINT AS retrying,
  coalesce(string_agg(failure_details, ',' ORDER BY failure_details) FILTER (status IN ('failed', 'partially_failed')), '') AS details FROM results GROUP BY batch""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "partially_failed").when(kind == "signup", "created").otherwise("completed")
    results = events(spark, sf_dir).select(F.col("user_id").alias("batch"), status.alias("status"), F.concat(F.lit("at "), F.col("event_id").cast("string")).alias("failure_details"))
    return records.batch_summary(results, "batch").select("batch", "total", "completed", "failed", "created", "retrying", F.array_join("failure_details", ",").alias("details"))


@query("a14_best_scores", "SELECT l_orderkey, max(l_discount) AS best, max(CASE WHEN l_linenumber <> 1 THEN l_discount END) AS best_other FROM lineitem GROUP BY l_orderkey")
def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lineitem(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("candidate_id"), F.lit(1).alias("winner"), F.col("l_discount").alias("probability"))
    return records.best_scores(scored, "l_orderkey", "winner")


@query("u03_first_positions", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem GROUP BY l_partkey")
def first_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_positions(lineitem(spark, sf_dir).select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place")), "l_partkey", "place")


_DOI_SQL = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://doi.org/10.' || (1000 + page_id) || '/a b' WHEN 1 THEN ' DOI: 10.' || (1000 + page_id) || '/x' WHEN 2 THEN 'http://dx.doi.org/10.1234/' || page_id
  WHEN 3 THEN '10.12/' || page_id ELSE '10.5555/e' || chr(769) || page_id END AS raw FROM pages"""


@query("x01_canonical_doi", f"SELECT page_id, CASE page_id % 5 WHEN 1 THEN '10.' || (1000 + page_id) || '/x' WHEN 2 THEN '10.1234/' || page_id WHEN 4 THEN '10.5555/' || chr(233) || page_id END AS doi FROM ({_DOI_SQL})")
def canonical_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rest = F.col("page_id"), F.col("page_id") % 5
    num = n.cast("string")
    raw = F.when(rest == 0, F.concat(F.lit("https://doi.org/10."), (n + 1000).cast("string"), F.lit("/a b"))).when(rest == 1, F.concat(F.lit(" DOI: 10."), (n + 1000).cast("string"), F.lit("/x")))
    raw = raw.when(rest == 2, F.concat(F.lit("http://dx.doi.org/10.1234/"), num)).when(rest == 3, F.concat(F.lit("10.12/"), num)).otherwise(F.concat(F.lit("10.5555/é"), num))
    return pages(spark, sf_dir).select("page_id", identifiers.canonical("doi", raw).alias("doi"))


@query("x02_canonical_ids", "SELECT page_id, page_id::VARCHAR AS pro_quest, 'ED' || page_id AS eric, CASE WHEN page_id % 2 = 0 THEN 'W' || page_id END AS open_alex, CASE WHEN page_id > 0 THEN page_id::VARCHAR END AS pm_id FROM pages")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = F.col("page_id").cast("string")
    made = {
        "pro_quest": F.concat(F.lit("https://www.proquest.com/docview/"), num),
        "eric": F.concat(F.lit("http://files.eric.ed.gov/fulltext/ED"), num, F.lit(".pdf")),
        "open_alex": F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://openalex.org/works/W"), num)).otherwise(F.concat(F.lit("A"), num)),
        "pm_id": num,
    }
    return pages(spark, sf_dir).select("page_id", *(identifiers.canonical(k, c).alias(k) for k, c in made.items()))


@query("x04_lookups", f"WITH {corpus.IDENTIFIERS_SQL} SELECT reference_id, identifier_type, identifier, other_identifier_name, count(*) AS n FROM identifiers GROUP BY ALL")
def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = identifiers.format_lookup(F.col("identifier_type"), F.col("identifier"), F.col("other_identifier_name"))
    read = corpus.page_identifiers(spark, sf_dir).select("reference_id", identifiers.parse_lookup(line).alias("l")).select("reference_id", "l.*")
    return read.groupBy("reference_id", "identifier_type", "identifier", "other_identifier_name").agg(F.count(F.lit(1)).alias("n"))


@query("x10_author_terms", r"""WITH t AS (SELECT doc_id, list_distinct(list_filter([regexp_extract_all(split_part(text, ' ', 1), '\p{L}+')[1], regexp_extract_all(split_part(text, ' ', 2), '\p{L}+')[1]], lambda x: x IS NOT NULL AND length(x) >= 2)) AS names FROM documents)
  SELECT doc_id, len(names) AS n FROM t""")
def author_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda i: F.regexp_extract(F.split_part("text", F.lit(" "), F.lit(i)), r"\p{L}+", 0)
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.size(text.author_terms(F.array(word(1), word(2)))).cast("long").alias("n"))


@query("x12_chunks", "SELECT l_orderkey, (count(*) + 2) // 3 AS n_chunks, count(*) - 3 * ((count(*) + 2) // 3 - 1) AS in_last FROM lineitem GROUP BY l_orderkey")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lineitem(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("items")).select("l_orderkey", text.chunks(F.col("items"), 3).alias("c"))
    return cut.select("l_orderkey", F.size("c").cast("long").alias("n_chunks"), F.size(F.element_at("c", -1)).cast("long").alias("in_last"))


@query("x13_text_rules", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS pagination, o_orderstatus || '/' || o_orderpriority AS qualified,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '-' || o_orderkey END AS pages, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE o_orderkey % 7 END AS y, ['a', 'b'] = ['a', 'b'] AS items FROM orders""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    pagination = text.blank_to_null(F.when(key % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))))
    number = F.col("o_custkey").cast("string")
    items = text.stripped_items(F.array(F.lit(" a "), F.lit(None).cast("string"), F.lit("  "), F.lit("b"))) == F.array(F.lit("a"), F.lit("b"))
    return orders(spark, sf_dir).select("o_orderkey", pagination.alias("pagination"), text.qualified_label(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("qualified"), text.page_range(number, F.when(even, key.cast("string"))).alias("pages"), text.year_or(F.lit(0), F.when(even, F.col("o_orderdate")), key % 7).cast("long").alias("y"), items.alias("items"))


@query("x17_layer_keys", f"WITH {corpus.LAYERS_SQL} SELECT enhancement_type, count(DISTINCT (scheme, coalesce(note, ''), quantity)) AS n FROM layers GROUP BY 1")
def layer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.line_enhancements(spark, sf_dir)
    layers = rows.select("enhancement_type", F.col("scheme").alias("source"), F.coalesce("note", F.lit("")).alias("visibility"), F.lit("1").alias("robot_version"), F.array(F.lit("b"), F.lit("a")).alias("derived_from"), "quantity", F.col("created_at").alias("updated_date"))
    key = text.layer_key(text.fingerprint("quantity", "updated_date", kind="bibliographic"))
    return layers.groupBy("enhancement_type").agg(F.count_distinct(key).alias("n"))


@query("x22_content_types", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/jsonl' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/json' END AS content_type FROM pages")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".jsonl", ".CSV", ".json", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", text.content_type(F.concat(F.lit("a.b/file"), ending)).alias("content_type"))


@query("x31_presenters", f"""WITH {corpus.IDENTIFIERS_SQL}, n AS (SELECT reference_id, identifier_type, identifier FROM identifiers)
  SELECT reference_id, min(identifier) FILTER (identifier_type = 'doi') AS doi, CASE WHEN reference_id % 3 = 0 THEN NULL ELSE reference_id % 3 = 1 END AS relevant FROM n GROUP BY reference_id""")
def presenters(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = corpus.page_identifiers(spark, sf_dir).groupBy("reference_id").agg(F.array_sort(F.collect_list(F.struct("identifier_type", "identifier"))).alias("ids"))
    note = lambda kind, value: F.struct(F.lit("s").alias("scheme"), F.lit("relevant").alias("label"), F.lit(kind).alias("annotation_type"), value.alias("value"))
    notes = F.when(F.col("reference_id") % 3 == 0, F.array(note("score", F.lit(True)))).otherwise(F.array(note("boolean", F.col("reference_id") % 3 == 2), note("boolean", F.col("reference_id") % 3 == 1)))
    return whole.select("reference_id", records.first_identifier(F.col("ids"), "doi").alias("doi"), records.bool_annotation(notes, "s", "relevant").alias("relevant"))


@query("x29_kind_of_url", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'doi' WHEN 1 THEN 'eric' WHEN 2 THEN 'pro_quest' END AS kind FROM pages")
def kind_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.element_at(F.array(*map(F.lit, ("https://doi.org/eric", "https://eric.ed.gov/?id=ED1", "https://search.proquest.com/docview/1", "https://example.org/"))), (F.col("page_id") % 4 + 1).cast("int"))
    return pages(spark, sf_dir).select("page_id", identifiers.kind_of_url(url).alias("kind"))


@query("x32_format_errors", "SELECT n_nationkey, n_name || chr(10) || chr(10) || 'b' AS errors FROM nation")
def format_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation(spark, sf_dir).select("n_nationkey", text.format_errors(F.array(F.concat(F.lit(" \n"), "n_name", F.lit("\n")), F.lit("b "))).alias("errors"))


@query("p02_search_documents", f"""WITH {corpus.LAYERS_SQL}, {corpus.DECISIONS_SQL},
  s AS (SELECT l.*, coalesce(canonical_reference_id, reference_id) AS id, canonical_reference_id IS NULL AS own FROM layers l LEFT JOIN decisions USING (reference_id)),
  a AS (SELECT id, scheme, number % 2 = 0 AS value FROM s QUALIFY rank() OVER (PARTITION BY id, scheme ORDER BY own DESC, created_at DESC, tie DESC) = 1)
  SELECT id, last(quantity ORDER BY own, created_at, tie) FILTER (enhancement_type = 'bibliographic' AND quantity <> 0) AS quantity, last(part ORDER BY own, created_at, tie) FILTER (enhancement_type = 'bibliographic' AND part <> 0) AS part,
    arg_max_null(note, (own, created_at, tie)) FILTER (enhancement_type = 'abstract') AS abstract,
    (SELECT coalesce(string_agg(DISTINCT scheme || '/x', ',' ORDER BY scheme || '/x') FILTER (value), '') FROM a WHERE a.id = s.id) AS annotations,
    (SELECT string_agg(DISTINCT scheme, ',' ORDER BY scheme) FROM a WHERE a.id = s.id) AS evaluated
  FROM s GROUP BY id""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.line_enhancements(spark, sf_dir)
    notes = rows.select("reference_id", "created_at", "tie", "scheme", F.lit("x").alias("label"), F.lit("boolean").alias("annotation_type"), (F.col("number") % 2 == 0).alias("value"))
    docs = records.search_documents(rows.withColumnRenamed("note", "abstract"), notes, corpus.order_decisions(spark, sf_dir), ["quantity", "part"])
    return docs.select("id", "quantity", "part", "abstract", F.array_join("annotations", ",").alias("annotations"), F.array_join("evaluated_schemes", ",").alias("evaluated"))


@query("p02_linked_fields", f"""WITH {corpus.DECISIONS_SQL}, o AS (SELECT o_orderkey AS r, n_name, r_name, r_regionkey, o_orderkey % 3 AS status FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderkey % 5 <> 0),
  l AS (SELECT coalesce(canonical_reference_id, reference_id) AS id, o.* FROM decisions JOIN o ON o.r = reference_id QUALIFY row_number() OVER (PARTITION BY id ORDER BY r = id DESC, r DESC) = 1)
  SELECT id, CASE WHEN status <> 1 THEN n_name ELSE '' END AS concepts, CASE WHEN status <> 1 THEN 'label of ' || n_name ELSE '' END AS labels, CASE WHEN r_regionkey < 4 THEN 'property ' || r_name ELSE '' END AS evaluated,
    CASE WHEN r % 2 = 0 THEN upper(n_name) ELSE '' END AS countries, CASE WHEN r % 2 = 0 THEN r_name ELSE '' END AS regions FROM l""")
def linked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' linked data, four of five have it: their customer's nation as a coded concept, and of even ones as a country."""
    key = F.col("o_orderkey")
    places = nation(spark, sf_dir).join(corpus.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders(spark, sf_dir).where("o_orderkey % 5 <> 0").join(customer(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey")).join(places, F.col("n_nationkey") == F.col("c_nationkey"))
    coded = F.struct(F.when(key % 3 == 0, "coded").when(key % 3 == 1, "not_coded").alias("status"), F.struct(F.col("n_name").alias("@id")).alias("value"))
    place = F.when(key % 2 == 0, F.struct(F.lit("coded").alias("status"), F.struct(F.lower("n_name").alias("@value")).alias("value")))
    layers = rows.select(key.alias("reference_id"), F.lit(1).alias("created_at"), key.alias("tie"), F.to_json(F.struct(coded.alias("topic"), place.alias("place"))).alias("data"))
    regions = places.select(F.upper("n_name").alias("country"), F.col("r_name").alias("region"))
    found = records.linked_fields(layers, corpus.order_decisions(spark, sf_dir), _vocabulary(spark, sf_dir), ["place"], regions)
    return found.select("id", *(F.array_join(c, ",").alias(c) for c in ("concepts", "labels", "evaluated", "countries", "regions")))


@query("p02_projected_scores", f"""WITH {corpus.DECISIONS_SQL}, a AS (SELECT coalesce(d.canonical_reference_id, d.reference_id) AS id, d.canonical_reference_id IS NULL AS own, l_shipdate AS ship, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS VARCHAR) AS tie, l_linenumber AS n,
    l_returnflag = 'R' AS risky, CASE WHEN l_linestatus = 'O' THEN l_discount ELSE 1 - l_discount END AS s FROM lineitem JOIN decisions d ON d.reference_id = l_orderkey)
  SELECT id, round(arg_max(s, row(own, ship, tie, n)), 6) AS inclusion, round(arg_max(s, row(own, ship, tie, n)) FILTER (risky), 6) AS risk FROM a GROUP BY id""")
def projected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as annotations of their order, true where open; the last one of the scheme, and of those labelled R."""
    none = F.lit(None).cast("double")
    rows = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("reference_id"), F.col("l_shipdate").alias("created_at"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]).alias("tie"), F.col("l_linenumber").alias("position"), F.lit("inclusion").alias("scheme"), F.col("l_returnflag").alias("label"), F.lit("boolean").alias("annotation_type"), (F.col("l_linestatus") == "O").alias("value"), F.col("l_discount").alias("score"), none.alias("data_score"))
    found = records.projected_scores(rows, corpus.order_decisions(spark, sf_dir), {"inclusion": ("inclusion", None), "risk": ("inclusion", "R")})
    return found.select("id", F.round("inclusion", 6).alias("inclusion"), F.round("risk", 6).alias("risk"))


@query("p04_inclusion_score", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 0.5 WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN l_discount ELSE 1 - l_discount END ELSE l_discount END AS score FROM lineitem""")
def inclusion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    score = records.inclusion_score(F.when(flag == "R", "boolean").otherwise("score"), F.col("l_linestatus") == "O", F.col("l_discount"), F.when(flag == "A", 0.5))
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))


@query("p07_papers", f"""WITH {corpus.LAYERS_SQL}, t AS (SELECT * REPLACE (CASE WHEN number <> 2 THEN created_at END AS created_at) FROM layers WHERE enhancement_type = 'bibliographic')
  SELECT reference_id, last(quantity ORDER BY created_at NULLS FIRST, tie) FILTER (quantity <> 0) AS quantity, last(note ORDER BY created_at NULLS FIRST, tie) FILTER (note <> '') AS note FROM t GROUP BY reference_id""")
def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.line_enhancements(spark, sf_dir).where("enhancement_type = 'bibliographic'").withColumn("created_at", F.when(F.col("number") != 2, F.col("created_at")))
    return records.last_values(rows, "reference_id", ["created_at", "tie"], ["quantity", "note"])


@query("p11_resync", f"""WITH {corpus.DECISIONS_SQL} SELECT reference_id AS id, CASE WHEN reference_id IN (SELECT coalesce(d.canonical_reference_id, c_custkey) FROM customer LEFT JOIN decisions d ON d.reference_id = c_custkey) THEN 'new' ELSE 'old' END AS version
  FROM decisions WHERE canonical_reference_id IS NULL""")
def resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = corpus.order_decisions(spark, sf_dir)
    canonical = decisions.where("canonical_reference_id is null").select(F.col("reference_id").alias("id"))
    # Documents of references that were canonical before, those of the changed ones among them.
    before = canonical.unionByName(customer(spark, sf_dir).select(F.col("c_custkey").alias("id")).join(decisions.where("canonical_reference_id is not null").select(F.col("reference_id").alias("id")), "id", "left_semi"))
    changed = customer(spark, sf_dir).select(F.col("c_custkey").alias("reference_id"))
    return records.resync(before.withColumn("version", F.lit("old")), changed, decisions, canonical.withColumn("version", F.lit("new")))


@query("p15_available_fields", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS n FROM orders")
def available_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("title"), F.when(F.col("o_orderstatus") == "F", "compared").otherwise("missing"), F.lit("year"), F.lit("missing"))
    return orders(spark, sf_dir).select("o_orderkey", F.size(records.available_fields(fields)).alias("n"))


def _papers(spark: SparkSession, sf_dir: str, undated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as records to look for, some without a year if ``undated``, and documents as the corpus."""
    docs = corpus.document_refs(spark, sf_dir).select("id", "title", F.array(F.col("source"), F.concat_ws(" ", "lang", "source")).alias("authors"), (1990 + F.col("id") % 4).alias("year"), F.when(F.col("id") % 7 == 0, "duplicate").otherwise("canonical").alias("determination"))
    item = F.col("item_id")
    year = 1990 + item % 4
    asked = corpus.table(spark, sf_dir, "benchmark").select(item.alias("query_id"), F.col("text").alias("title"), F.array(F.lit("fr anna"), F.lit("en bob")).alias("authors"), (F.when(item % 5 != 0, year) if undated else year).alias("year"))
    return asked, docs


#: DuckDB's edit distances count bytes, so the letters of two bytes in the test tables stand as capitals there.
_ONE_BYTE = "translate({}, 'ñèéêíçóüöäß', 'ABCDEFGHIJK')"
#: Letters that changed places with a letter put in between them, which its distance takes for two edits.
_BETWEEN = """length({1}) = length({0}) + 1 AND coalesce(list_bool_or(list_transform(range(1, length({0})), lambda i:
            starts_with({1}, {0}[:i - 1] || {0}[i + 1]) AND ends_with({1}, {0}[i] || {0}[i + 2:]))), false)"""
_FORMS_SQL = f"""near AS (
        SELECT word, variant, edits, df FROM (
          SELECT v.word, d.word AS variant, {_ONE_BYTE.format('v.word')} AS a, {_ONE_BYTE.format('d.word')} AS b, damerau_levenshtein(a, b) AS edits, df
          FROM (SELECT DISTINCT word FROM q) v JOIN df d ON abs(length(v.word) - length(d.word)) <= 2
            AND damerau_levenshtein({_ONE_BYTE.format('v.word')}, {_ONE_BYTE.format('d.word')}) <= CASE WHEN length(v.word) <= 2 THEN 0 WHEN length(v.word) <= 5 THEN 1 ELSE 2 END)
        WHERE levenshtein(a, b) <= 2 OR NOT ({_BETWEEN.format('a', 'b')} OR {_BETWEEN.format('b', 'a')})),
      forms AS (SELECT word, variant, boost, max(df) OVER (PARTITION BY word) AS df FROM (
        SELECT *, 1 - edits / least(length(word), length(variant)) AS boost FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY boost DESC, variant) <= 50))"""


def _candidates_sql(window: str, factor: str, fuzzy: bool = False, asked: str = "true", year: str = "1990 + item_id % 4") -> str:
    return f"""WITH {corpus.REFS_SQL}, docs AS (SELECT id, {TOKENS.format('title')} AS ws, 1990 + id % 4 AS y FROM refs),
      stats AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avgdl FROM docs), idx AS (SELECT id, word, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ws) AS dl, unnest(ws) AS word FROM docs) GROUP BY id, word),
      df AS (SELECT word, count(*) AS df FROM idx GROUP BY word),
      q AS (SELECT item_id AS query_id, {year} AS qy, greatest(1, floor(0.5 * len(ws))) AS need, unnest(ws) AS word FROM (SELECT item_id, list_distinct({TOKENS.format('text')}) AS ws FROM benchmark) WHERE {asked}),
      {_FORMS_SQL if fuzzy else "forms AS (SELECT word, word AS variant, 1.0 AS boost, df FROM df)"},
      s AS (SELECT q.query_id, idx.id, any_value(qy) AS qy, round(sum(2.0 * boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS title_score
        FROM q JOIN forms USING (word) CROSS JOIN stats JOIN idx ON idx.word = forms.variant WHERE q.query_id <> idx.id GROUP BY q.query_id, idx.id HAVING count(DISTINCT q.word) >= any_value(need)),
      aw AS (SELECT id, word, count(*) AS tf FROM (SELECT doc_id AS id, unnest([source, lang, source]) AS word FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY ALL), adf AS (SELECT word, count(*) AS df FROM aw GROUP BY word),
      clause AS (SELECT unnest([0, 0, 1, 1]) AS c, unnest(['fr', 'anna', 'en', 'bob']) AS word),
      cs AS (SELECT s.query_id, s.id, c, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 3 / 3.0))) AS v FROM s, stats, clause JOIN adf USING (word) JOIN aw USING (word) WHERE aw.id = s.id GROUP BY ALL),
      au AS (SELECT query_id, id, max(v) + 0.1 * (sum(v) - max(v)) AS author_score FROM cs GROUP BY ALL),
      f AS (SELECT s.query_id, s.id, round((title_score + coalesce(author_score, 0)) * {factor}, 6) AS score FROM s JOIN docs d USING (id) LEFT JOIN au ON au.query_id = s.query_id AND au.id = s.id WHERE s.id % 7 <> 0 AND {window})
      SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10"""


def _candidates(policy: str, undated: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked, docs = _papers(spark, sf_dir, undated)
        return linkage.ranked_candidates(asked, docs, linkage.CandidateSearch(linkage.POLICIES[policy]))

    return run


_FADING = "CASE WHEN qy IS NULL THEN 1 ELSE 1 + 0.1 * exp(ln(0.5) / 9 * greatest(0.0, abs(y - qy) - 1)) END"
_DATED, _SOME_YEARS = "item_id % 5 <> 0", "CASE WHEN item_id % 5 <> 0 THEN 1990 + item_id % 4 END"
query("d03_candidates_soft_decay", _candidates_sql("true", _FADING))(_candidates("candidate_selection_v1"))
query("d04_candidates_no_year_filter", _candidates_sql("true", "1", fuzzy=True))(_candidates("no_year_filter_v1"))
query("d06_candidates_hard_window", _candidates_sql("abs(y - qy) <= 1", "1", fuzzy=True))(_candidates("current_fuzzy_v1"))
query("d04_candidates_soft_year_decay", _candidates_sql("true", _FADING, fuzzy=True, asked=_DATED))(_candidates("soft_year_decay_v1", undated=True))
query("d04_candidates_nonfuzzy_probe", _candidates_sql("true", _FADING, asked=_DATED))(_candidates("soft_year_decay_nonfuzzy_probe_v1", undated=True))
query("d04_candidates_year_optional", _candidates_sql("true", "1", fuzzy=True, year=_SOME_YEARS))(_candidates("no_year_filter_year_optional_v1", undated=True))
query("d04_candidates_decay_year_optional", _candidates_sql("true", _FADING, fuzzy=True, year=_SOME_YEARS))(_candidates("soft_year_decay_year_optional_v1", undated=True))


@query("d03_near_words", f"""WITH {corpus.REFS_SQL}, df AS (SELECT word, count(DISTINCT id) AS df FROM (SELECT id, unnest({TOKENS.format('title')}) AS word FROM refs) GROUP BY word),
      q AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS word FROM benchmark), {_FORMS_SQL}
      SELECT word, variant, round(boost, 6) AS boost, df FROM forms""")
def near_title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = linkage.count_words(corpus.document_refs(spark, sf_dir), "id", "title").df
    words = corpus.table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    return nearwords.expansions(words, vocabulary).select("word", "variant", F.round("boost", 6).alias("boost"), "df")


@query("d05_searchable_reasons", """SELECT o_orderkey AS query_id, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'no title' END, CASE WHEN o_orderkey % 3 = 0 THEN 'no authors' END, CASE WHEN o_orderkey % 5 = 0 THEN 'no year' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM orders""")
def searchable_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    rows = orders(spark, sf_dir).select(key.alias("query_id"), F.when(key % 2 == 0, " ").otherwise("t").alias("title"), F.when(key % 3 == 0, none).otherwise(F.array(F.lit("a"))).alias("authors"), F.when(key % 5 == 0, 0).otherwise(1999).alias("year"))
    asked = linkage.CandidateSearch(linkage.POLICIES["candidate_selection_v1"])
    return asked.usable(rows).select("query_id", F.array_join("reasons", "; ").alias("reasons"))


@query("d09_merged_candidates", """WITH a AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS c FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS q, l_partkey AS c, max(l_discount) AS s FROM lineitem GROUP BY ALL),
  m AS (SELECT coalesce(a.q, b.q) AS query_id, coalesce(a.c, b.c) AS canonical_id, a.q IS NOT NULL AS by_identifier, b.q IS NOT NULL AS by_search, s AS score FROM a FULL JOIN b ON a.q = b.q AND a.c = b.c)
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY by_search, score DESC NULLS FIRST, canonical_id) AS INTEGER) AS place FROM m""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), "l_returnflag", "l_discount")
    known = rows.where("l_returnflag = 'R'").select("query_id", F.col("id").alias("canonical_id")).distinct()
    ranked = rows.groupBy("query_id", "id").agg(F.max("l_discount").alias("score"))
    return linkage.merge_candidates(known, ranked)


@query("d14_assessment", """WITH c AS (SELECT l_orderkey AS q, l_partkey AS c FROM lineitem), p AS (SELECT c.q, c.c, (a.p_type = b.p_type)::INT * 0.5 + (a.p_brand = b.p_brand)::INT * 0.5 AS v, a.p_partkey IS NOT NULL AS known, b.p_partkey IS NOT NULL AS there FROM c LEFT JOIN part a ON a.p_partkey = c.q LEFT JOIN part b ON b.p_partkey = c.c)
  SELECT q AS query_id, count(*) FILTER (v >= 1) AS n_clearing, max(v)::DOUBLE AS best, CASE WHEN count(*) FILTER (v IS NULL) > 0 OR count(*) FILTER (v >= 1) > 1 THEN 'no_proposal' WHEN count(*) FILTER (v >= 1) = 1 THEN 'propose_duplicate' ELSE 'propose_canonical' END AS outcome FROM p GROUP BY q""")
def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("candidate_id"))
    alike = lambda a, b: (a["p_type"] == b["p_type"]).cast("int") * 0.5 + (a["p_brand"] == b["p_brand"]).cast("int") * 0.5
    found = linkage.assess(pairs, part(spark, sf_dir).select(F.col("p_partkey").alias("id"), "p_type", "p_brand"), lambda a, b: alike(a, b).cast("double"), 1.0)
    return found.select("query_id", "n_clearing", "best", "outcome")


@query("d16_recorded", """WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'propose_canonical' ELSE 'no_proposal' END AS outcome, o_orderpriority AS payload FROM orders), b AS (SELECT c_custkey AS k, 'before' AS outcome, NULL AS payload FROM customer)
  SELECT n.k, coalesce(b.outcome, n.outcome) AS outcome, CASE WHEN b.k IS NULL AND n.outcome <> 'propose_canonical' THEN n.payload END AS payload FROM n LEFT JOIN b ON b.k = n.k""")
def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "propose_canonical").otherwise("no_proposal").alias("outcome"), F.col("o_orderpriority").alias("payload"))
    before = customer(spark, sf_dir).select(F.col("c_custkey").alias("k"), F.lit("before").alias("outcome"), F.lit(None).cast("string").alias("payload"))
    return linkage.recorded(new, before, "k")


_MANUAL_SQL = f"""WITH {corpus.DECISIONS_SQL}, m AS (SELECT c_custkey AS r, d.duplicate_determination = 'canonical' AND c_custkey NOT IN (SELECT canonical_reference_id FROM decisions WHERE canonical_reference_id IS NOT NULL) AS moves
    FROM customer LEFT JOIN decisions d ON d.reference_id = c_custkey + 1 WHERE c_custkey % 10 = 3)"""


def _manual(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every tenth customer's order becomes canonical, then a duplicate of the next order."""
    active = corpus.order_decisions(spark, sf_dir).select("reference_id", F.col("duplicate_determination").alias("determination"), F.col("canonical_reference_id").alias("canonical_id"), F.lit("system").alias("authority"))
    chosen = customer(spark, sf_dir).where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("reference_id"), F.lit("person").alias("authority"))
    first = chosen.select("*", F.lit("canonical").alias("determination"), F.lit(None).cast("long").alias("canonical_id"), (F.col("reference_id") * 2).alias("place"))
    then = chosen.select("*", F.lit("duplicate").alias("determination"), (F.col("reference_id") + 1).alias("canonical_id"), (F.col("reference_id") * 2 + 1).alias("place"))
    return decisions.decide_in_turn(active, first.unionByName(then))


@query("d18_manual_decisions", f"""{_MANUAL_SQL}
  SELECT reference_id, duplicate_determination AS determination, canonical_reference_id AS canonical_id FROM decisions WHERE reference_id NOT IN (SELECT r FROM m)
  UNION ALL SELECT r, CASE WHEN moves THEN 'duplicate' ELSE 'canonical' END, CASE WHEN moves THEN r + 1 END FROM m""")
def manual_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manual(spark, sf_dir)[0].drop("authority")


@query("d18_manual_outcomes", f"""{_MANUAL_SQL}, d AS (SELECT r, d.duplicate_determination IS NOT DISTINCT FROM 'canonical' AS was, n.duplicate_determination IS NOT DISTINCT FROM 'canonical' AS fits, moves FROM m LEFT JOIN decisions d ON d.reference_id = r LEFT JOIN decisions n ON n.reference_id = r + 1)
  SELECT r * 2 AS place, 'canonical' AS determination, true AS activate, NOT was AS changed, NULL AS reason FROM d
  UNION ALL SELECT r * 2 + 1, CASE WHEN fits THEN CASE WHEN moves THEN 'duplicate' ELSE 'decoupled' END END, coalesce(moves, false), fits, CASE WHEN NOT fits THEN 'the canonical is none' END FROM d""")
def manual_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manual(spark, sf_dir)[1].drop("reference_id")


def _import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for each page: whole, cut off, with an unknown key, without identifiers, partly and wholly wrong ones."""
    rest, num = F.col("page_id") % 6, F.col("page_id").cast("string")
    good, bad = F.concat(F.lit('{"identifier":"10.1234/'), num, F.lit('","identifier_type":"doi"}')), F.lit('{"identifier":"nothing","identifier_type":"doi"}')
    body = lambda *ids: F.concat(F.lit('{"identifiers":['), *ids, F.lit("]}"))
    line = F.when(rest == 0, body(good)).when(rest == 1, F.concat(F.lit('{"identifiers":['), good)).when(rest == 2, F.concat(F.lit('{"extra":1,"identifiers":['), good, F.lit("]}")))
    line = line.when(rest == 3, body()).when(rest == 4, body(good, F.lit(","), bad)).otherwise(body(bad))
    return pages(spark, sf_dir).select(F.col("page_id").alias("line_no"), line.alias("line"))


@query("i01_parsed_lines", """SELECT page_id AS line_no, CASE page_id % 6 WHEN 0 THEN 'ok' WHEN 4 THEN 'partial' ELSE 'failed' END AS status, CASE page_id % 6 WHEN 0 THEN 'completed' WHEN 4 THEN 'partially_failed' ELSE 'failed' END AS result,
  CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'unknown keys: extra' WHEN 3 THEN 'no valid identifier' WHEN 4 THEN 'invalid identifier' ELSE 'no valid identifier' || chr(10) || chr(10) || 'invalid identifier' END AS errors,
  CASE WHEN page_id % 6 IN (0, 2, 4) THEN 1 ELSE 0 END AS n_identifiers, 'public' AS visibility FROM pages""")
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_lines.parse_references(_import_lines(spark, sf_dir))
    return found.select("line_no", "status", ingest.import_result(F.col("status"), F.col("errors")).alias("result"), "errors", F.size("identifiers").alias("n_identifiers"), "visibility")


@query("t04_search_to_pending", f"""WITH {corpus.PENDING_SQL}, hits AS (SELECT o_orderkey % 500 AS r FROM orders WHERE o_orderstatus = 'P'), old AS (SELECT DISTINCT reference_id AS r, robot_id FROM pending WHERE robot_id = 7)
  SELECT DISTINCT h.r AS reference_id, 7 AS robot_id FROM hits h WHERE h.r NOT IN (SELECT r FROM old)""")
def search_to_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = orders(spark, sf_dir).where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 500).alias("reference_id"), F.lit(7).cast("long").alias("robot_id"))
    old = corpus.pending(spark, sf_dir).select("reference_id", F.col("robot_id").cast("long").alias("robot_id"))
    return relational.insert_ignore(old, hits, ["reference_id", "robot_id"]).select("reference_id", F.col("robot_id").cast("int").alias("robot_id"))


@query("t04_request_pages", "SELECT 7 AS request_id, o_orderkey AS reference_id, 'pending' AS status FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 10 <> 0")
def request_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search request whose first three pages of a hundred were taken in, gone on with from there; some had been asked for."""
    docs = orders(spark, sf_dir).withColumnRenamed("o_orderkey", "id")
    asked = search.Query(F.col("o_orderstatus") == "P")
    columns = ["request_id", "reference_id", "status", F.lit(None).cast("long").alias("retry_of")]
    # Every tenth is there from before; a retry of another is no reason to leave it out.
    early = docs.where("o_orderstatus = 'P' AND id % 10 IN (0, 1)").select(F.lit(7).alias("request_id"), F.col("id").alias("reference_id"), F.lit("early").alias("status"), F.when(F.col("id") % 10 == 1, F.col("id")).alias("retry_of"))
    first = workqueue.request_pages(early, docs, asked, 7, 1, "id", 100).where("page <= 3").select(*columns)
    done = lineage.cut(early.where("retry_of is not null").unionByName(first))
    last = workqueue.resume_key(done, 7)
    later = workqueue.request_pages(early.unionByName(first), docs, asked, 7, 1, "id", 100, after=last)
    again = workqueue.request_pages(early.unionByName(first), docs, asked, 7, 1, "id", 100).where("page <= 3")
    return done.where("retry_of is null").select(*columns[:3]).unionByName(later.select(*columns[:3])).unionByName(again.select(*columns[:3]))


@query("t07_lease", f"""WITH {corpus.PENDING_SQL}, c AS (SELECT id FROM (SELECT * FROM pending WHERE robot_id = 7 AND status = 'pending' QUALIFY row_number() OVER (PARTITION BY reference_id ORDER BY created_at, id) = 1) ORDER BY created_at, id LIMIT 20)
  SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'processing' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM c) THEN TIMESTAMP '2024-01-15 00:30:00' ELSE expires_at END > TIMESTAMP '2024-01-15 00:00:00' AS live FROM pending""")
def lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.pending(spark, sf_dir)
    now = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return workqueue.lease(rows, workqueue.claim(rows, 7, 20), now, 30).select("id", "status", (F.col("expires_at") > now).alias("live"))


@query("t12_accepted_layers", f"""WITH {corpus.DECISIONS_SQL}, n AS (SELECT l_orderkey * 10 + l_linenumber AS place, l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS r, min(l_suppkey) % 3 AS k, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE min(l_partkey) END AS o FROM lineitem GROUP BY l_orderkey, l_linenumber),
  t AS (SELECT reference_id AS r, coalesce(canonical_reference_id, reference_id) AS tree FROM decisions),
  m AS (SELECT n.*, a.tree IS NOT NULL AS there, a.tree IS DISTINCT FROM b.tree AS foreign_, row_number() OVER (PARTITION BY n.r, n.k ORDER BY n.place) AS nth FROM n LEFT JOIN t a ON a.r = n.r LEFT JOIN t b ON b.r = n.o)
  SELECT place, CASE WHEN NOT there OR foreign_ THEN 'failed' WHEN k = 0 AND r % 2 = 0 OR nth > 1 THEN 'discarded' ELSE 'accepted' END AS outcome FROM m""")
def accepted_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    lost = F.when(number == 7, 100000000).otherwise(0)
    one = lineitem(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    new = one.select((F.col("l_orderkey") * 10 + number).alias("place"), (F.col("l_orderkey") + lost).alias("reference_id"), (F.col("l_suppkey") % 3).cast("string").alias("content_key"), F.array(F.when(number % 2 == 0, F.col("l_orderkey")).otherwise(F.col("l_partkey"))).alias("derived_from"))
    references = orders(spark, sf_dir).select(F.col("o_orderkey").alias("reference_id"))
    had = references.where("reference_id % 2 = 0").withColumn("content_key", F.lit("0"))
    return records.accepted_layers(new, had, references, corpus.order_decisions(spark, sf_dir)).select("place", "outcome")


@query("t16_repair_ranges", """SELECT b.tile, count(*) AS n FROM orders JOIN (SELECT tile, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (SELECT o_orderkey, ntile((SELECT (count(*) + 1999) // 2000 FROM orders)) OVER (ORDER BY o_orderkey) AS tile FROM orders) GROUP BY tile) b
  ON o_orderkey BETWEEN low AND high GROUP BY b.tile""")
def repair_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select("o_orderkey")
    return relational.partition_boundaries(rows, "o_orderkey", 2000).select("tile", F.col("n_rows").alias("n"))


@query("snk16_result_file", """WITH l AS (SELECT event_id AS line_no, CASE WHEN event_type <> 'error' THEN user_id END AS reference_id FROM events), e AS (SELECT DISTINCT o_custkey AS reference_id FROM orders WHERE o_custkey % 2 = 0),
  k AS (SELECT l.*, e.reference_id IS NOT NULL AS asked FROM l LEFT JOIN e USING (reference_id)),
  o AS (SELECT line_no, reference_id, CASE WHEN reference_id IS NULL THEN 'not readable' WHEN NOT asked THEN 'not asked for' WHEN row_number() OVER (PARTITION BY reference_id ORDER BY line_no) > 1 THEN 'given twice' END AS error FROM k
    UNION ALL SELECT NULL, reference_id, 'not given' FROM e WHERE reference_id NOT IN (SELECT reference_id FROM l WHERE reference_id IS NOT NULL))
  SELECT line_no AS at, '{' || array_to_string(list_filter(['"reference_id":' || reference_id, '"error":"' || error || '"'], lambda x: x IS NOT NULL), ',') || '}' AS line FROM o""")
def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = events(spark, sf_dir).select(F.col("event_id").alias("line_no"), F.when(F.col("event_type") != "error", F.col("user_id")).alias("reference_id"), F.lit(True).alias("valid"))
    expected = orders(spark, sf_dir).where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("reference_id"))
    return sinks.result_lines(workqueue.classify_results(given, expected), {"parse_failure": "not readable", "not_requested": "not asked for", "repeated": "given twice", "invalid": "not valid", "missing": "not given"})


@query("a12_identifier_groups_of_orders", """WITH s AS (SELECT o_orderkey AS r, 'doi:' || o_custkey || ',pm_id:' || o_orderstatus AS ids FROM orders) SELECT ids, min(r) AS canonical, count(*) AS n_members FROM s GROUP BY ids HAVING count(*) > 1""")
def identifier_groups_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.identifier_groups(_order_identifiers(spark, sf_dir)).withColumn("ids", F.array_join("ids", ","))


def _order_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda kind, c: orders(spark, sf_dir).select(F.col("o_orderkey").alias("reference_id"), F.lit(kind).alias("identifier_type"), F.col(c).cast("string").alias("identifier"))
    return row("doi", "o_custkey").unionByName(row("pm_id", "o_orderstatus"))


@query("d08_identifier_candidates_of_orders", f"""WITH {corpus.DECISIONS_SQL}, ids AS (SELECT o_orderkey AS r, 'doi:' || o_custkey AS i FROM orders UNION ALL SELECT o_orderkey, 'pm_id:' || o_orderstatus FROM orders)
  SELECT a.r AS query_id, coalesce(d.canonical_reference_id, b.r) AS canonical_id, count(DISTINCT a.i) AS n_matched FROM ids a JOIN ids b ON a.i = b.i AND a.r <> b.r
  LEFT JOIN decisions d ON d.reference_id = b.r WHERE a.r <> coalesce(d.canonical_reference_id, b.r) GROUP BY 1, 2""")
def identifier_candidates_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by all trusted identifiers; a third of the orders share each status, so pairs grow with the square of the orders."""
    ids = _order_identifiers(spark, sf_dir)
    met = linkage.identifier_matches(ids.withColumn("query_id", F.col("reference_id")), ids, corpus.order_decisions(spark, sf_dir))
    return met.groupBy("query_id", "canonical_id").agg(F.count(F.lit(1)).alias("n_matched"))
