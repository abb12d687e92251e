"""Registered queries of records, linkage, queues, streams, vocabularies and sinks, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import identifiers, text
from quillspark.operators import lineage, linkage, records, relational, vocabulary, workqueue
from quillspark.plans import corpus
from quillspark.plans.search_queries import ORACLE, QUERIES, query
from quillspark.sources import sinks
from quillspark.streaming import ingest

__all__ = ["ORACLE", "QUERIES"]


@query("w02_last_values", f"""WITH {corpus.LAYERS_SQL}
  SELECT reference_id, last(number ORDER BY created_at, tie) FILTER (number <> 0) AS number, last(quantity ORDER BY created_at, tie) FILTER (quantity <> 0) AS quantity,
    last(note ORDER BY created_at, tie) FILTER (note <> '') AS note, last(part ORDER BY created_at, tie) FILTER (part <> 0) AS part, last(scheme ORDER BY created_at, tie) AS scheme
  FROM layers GROUP BY reference_id""")
def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_values(corpus.line_enhancements(spark, sf_dir), "reference_id", ["created_at", "tie"], ["number", "quantity", "note", "part", "scheme"])


@query("w02_last_wins", f"WITH {corpus.LAYERS_SQL} SELECT reference_id, arg_max_null(note, (created_at, tie)) AS note FROM layers GROUP BY reference_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_wins(corpus.line_enhancements(spark, sf_dir), "reference_id", ["created_at", "tie"], "note")


@query("p03_scheme_annotations", f"""WITH {corpus.LAYERS_SQL}
  SELECT reference_id, scheme, number FROM layers
  QUALIFY rank() OVER (PARTITION BY reference_id, scheme ORDER BY created_at DESC, tie DESC) = 1""")
def scheme_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.line_enhancements(spark, sf_dir).select("reference_id", "scheme", "number", "created_at", "tie")
    return records.annotations_by_scheme(rows, "reference_id", ["created_at", "tie"]).select("reference_id", "scheme", "number")


@query("p01_stars", f"""WITH {corpus.LAYERS_SQL}, {corpus.DECISIONS_SQL}
  SELECT coalesce(canonical_reference_id, reference_id) AS canonical_id, count_if(canonical_reference_id IS NULL) AS n_own, count(*) AS n
  FROM layers LEFT JOIN decisions USING (reference_id) GROUP BY 1""")
def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.star(corpus.line_enhancements(spark, sf_dir), corpus.order_decisions(spark, sf_dir))
    return found.groupBy("canonical_id").agg(F.count_if("own").alias("n_own"), F.count(F.lit(1)).alias("n"))


@query("d17_canonical_of", f"WITH {corpus.DECISIONS_SQL} SELECT reference_id, coalesce(canonical_reference_id, reference_id) AS canonical_id FROM decisions")
def canonical_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference_id"))
    return records.canonical_of(ids, corpus.order_decisions(spark, sf_dir)).select("reference_id", "canonical_id")


@query("j01_with_children", """SELECT o_orderkey, count(l_orderkey) AS n, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS lines
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    joined = records.with_children(corpus.table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "children", [], ["l_linenumber", "l_partkey"])
    return joined.select("o_orderkey", F.size("children").cast("long").alias("n"), F.nullif(F.array_join(F.transform("children", lambda c: c["l_linenumber"].cast("string")), ","), F.lit("")).alias("lines"))


@query("p09_batch_status", """
  WITH s AS (SELECT o_custkey, list(DISTINCT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partially_failed' ELSE 'failed' END) AS st FROM orders GROUP BY o_custkey)
  SELECT o_custkey, CASE WHEN st = ['completed'] THEN 'completed' WHEN NOT list_contains(st, 'completed') THEN 'failed' ELSE 'partially_failed' END AS status FROM s""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "partially_failed").otherwise("failed")
    sets = corpus.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(status).alias("st"))
    return sets.select("o_custkey", records.batch_status(F.col("st")).alias("status"))


@query("p10_request_status", f"""WITH {corpus.PENDING_SQL}, s AS (SELECT reference_id, list(DISTINCT status) AS st FROM pending GROUP BY reference_id)
  SELECT reference_id, CASE WHEN st = ['pending'] THEN 'received' WHEN list_has_any(st, ['pending', 'processing', 'importing', 'indexing']) THEN 'processing'
    WHEN st = ['completed'] THEN 'completed' WHEN st = ['failed'] THEN 'failed' ELSE 'partial_failed' END AS status FROM s""")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = corpus.pending(spark, sf_dir).groupBy("reference_id").agg(F.collect_set("status").alias("st"))
    return sets.select("reference_id", records.request_status(F.col("st"), F.lit("received")).alias("status"))


@query("a12_identifier_groups", f"""WITH {corpus.IDENTIFIERS_SQL},
  sets AS (SELECT reference_id, string_agg(DISTINCT identifier_type || ':' || identifier, ',' ORDER BY identifier_type || ':' || identifier) AS ids FROM identifiers GROUP BY reference_id)
  SELECT ids, min(reference_id) AS canonical, count(*) AS n_members FROM sets GROUP BY ids HAVING count(*) > 1""")
def identifier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.identifier_groups(corpus.page_identifiers(spark, sf_dir)).withColumn("ids", F.array_join("ids", ","))


def _lookups(ids: DataFrame) -> DataFrame:
    return ids.where("reference_id in (5, 17)").drop("reference_id")


_LOOKUPS_SQL = f"WITH {corpus.IDENTIFIERS_SQL}, wanted AS (SELECT DISTINCT identifier_type, identifier, other_identifier_name FROM identifiers WHERE reference_id IN (5, 17))"
_SAME_SQL = "i.identifier_type = w.identifier_type AND i.identifier = w.identifier AND i.other_identifier_name IS NOT DISTINCT FROM w.other_identifier_name"


@query("f12_identifiers_any", f"{_LOOKUPS_SQL} SELECT DISTINCT i.reference_id FROM identifiers i JOIN wanted w ON {_SAME_SQL}")
def identifiers_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus.page_identifiers(spark, sf_dir)
    return linkage.find_by_identifiers(ids, _lookups(ids))


@query("f13_identifiers_all", f"""WITH {corpus.IDENTIFIERS_SQL}, wanted AS (SELECT DISTINCT identifier_type, identifier, other_identifier_name FROM identifiers WHERE reference_id = 5)
  SELECT reference_id FROM (SELECT DISTINCT i.reference_id, w.* FROM identifiers i JOIN wanted w ON {_SAME_SQL}) GROUP BY reference_id HAVING count(*) = (SELECT count(*) FROM wanted)""")
def identifiers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus.page_identifiers(spark, sf_dir)
    return linkage.find_by_identifiers(ids, ids.where("reference_id = 5"), "all")


def _tens(ids: DataFrame) -> DataFrame:
    """Decisions that make every reference a duplicate of the least of its ten."""
    refs = ids.select("reference_id").distinct()
    least = F.col("reference_id") - F.col("reference_id") % 10
    return refs.where(least != F.col("reference_id")).select("reference_id", F.lit(True).alias("active_decision"), F.lit("duplicate").alias("duplicate_determination"), least.alias("canonical_reference_id"))


@query("d08_identifier_candidates", f"""WITH {corpus.IDENTIFIERS_SQL}
  SELECT a.reference_id AS query_id, b.reference_id - b.reference_id % 10 AS canonical_id, count(DISTINCT a.identifier_type || ':' || a.identifier) AS n_matched
  FROM identifiers a JOIN identifiers b ON a.identifier_type = b.identifier_type AND a.identifier = b.identifier AND a.reference_id <> b.reference_id
  WHERE a.identifier_type IN ('doi', 'pm_id', 'open_alex') AND a.reference_id <> b.reference_id - b.reference_id % 10 GROUP BY 1, 2""")
def identifier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus.page_identifiers(spark, sf_dir)
    found = linkage.identifier_candidates(ids.withColumn("query_id", F.col("reference_id")), ids, _tens(ids))
    return found.select("query_id", "canonical_id", F.size("matched").cast("long").alias("n_matched"))


@query("d02_shortcut", """SELECT o_custkey AS query_id, CASE WHEN count(DISTINCT o_orderkey % 7) > 1 THEN 'decoupled' ELSE 'duplicate' END AS duplicate_determination,
  CASE WHEN count(DISTINCT o_orderkey % 7) = 1 THEN min(o_orderkey % 7) END AS canonical_id FROM orders GROUP BY o_custkey""")
def shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id"))
    return linkage.shortcut(rows.agg(F.collect_set(F.col("o_orderkey") % 7).alias("canonicals")).withColumn("has_trusted", F.lit(True)))


_MAP_SQL = """SELECT *, CASE WHEN active_authority = 'person' AND new_authority = 'system' THEN 1
    WHEN active_determination = 'duplicate' AND (new_determination = 'canonical' OR (new_determination = 'duplicate' AND new_canonical IS DISTINCT FROM active_canonical)) THEN 2
    WHEN new_determination = 'duplicate' AND has_duplicates THEN 3 ELSE 4 END AS c FROM rows"""


@query("d12_decision_table", f"""WITH rows AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'canonical' ELSE 'duplicate' END AS new_determination, CASE WHEN l_returnflag <> 'R' THEN l_suppkey % 3 END AS new_canonical,
      CASE WHEN l_linestatus = 'O' THEN 'system' ELSE 'person' END AS new_authority, CASE l_linenumber % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'duplicate' END AS active_determination,
      CASE WHEN l_linenumber % 3 = 1 THEN l_partkey % 3 END AS active_canonical, CASE WHEN l_linenumber % 3 < 2 THEN CASE WHEN l_tax > 0.05 THEN 'person' ELSE 'system' END END AS active_authority, l_discount > 0.05 AS has_duplicates
    FROM lineitem), mapped AS ({_MAP_SQL})
  SELECT CASE WHEN c = 4 THEN new_determination ELSE 'decoupled' END AS determination, c = 4 AS activate,
    CASE c WHEN 1 THEN false WHEN 4 THEN NOT (new_determination IS NOT DISTINCT FROM active_determination AND new_canonical IS NOT DISTINCT FROM active_canonical) ELSE true END AS changed, count(*) AS n
  FROM mapped GROUP BY ALL""")
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("l_linenumber") % 3
    rows = corpus.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "canonical").otherwise("duplicate").alias("new_determination"),
        F.when(F.col("l_returnflag") != "R", F.col("l_suppkey") % 3).alias("new_canonical"),
        F.when(F.col("l_linestatus") == "O", "system").otherwise("person").alias("new_authority"),
        F.when(third == 0, "canonical").when(third == 1, "duplicate").alias("active_determination"),
        F.when(third == 1, F.col("l_partkey") % 3).alias("active_canonical"),
        F.when(third < 2, F.when(F.col("l_tax") > 0.05, "person").otherwise("system")).alias("active_authority"),
        (F.col("l_discount") > 0.05).alias("has_duplicates"),
    )
    return linkage.map_decision(rows).groupBy("determination", "activate", "changed").agg(F.count(F.lit(1)).alias("n"))


@query("d15_outcomes", """
  SELECT l_orderkey AS query_id, count_if(l_discount >= 0.08) AS n_clearing, max(l_discount) AS best,
    CASE WHEN count_if(l_discount >= 0.08) > 1 THEN 'no_proposal' WHEN count_if(l_discount >= 0.08) = 1 THEN 'propose_duplicate' WHEN bool_and(l_tax < 0.08) THEN 'propose_canonical' ELSE 'no_proposal' END AS outcome
  FROM lineitem GROUP BY l_orderkey""")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("candidate_id"), F.col("l_discount").alias("probability"), (F.col("l_tax") < 0.08).alias("searchable"))
    return linkage.outcome(scored, 0.08)


@query("d13_invalid_decisions", """SELECT o_orderkey AS reference_id, CASE WHEN o_orderkey % 5 = 0 THEN 'a reference duplicates itself' ELSE 'a duplicate needs a canonical' END AS reason
  FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 IN (0, 1)""")
def invalid_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.col("o_orderkey") % 5
    rows = corpus.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("reference_id"),
        F.lit(True).alias("active_decision"),
        F.when(F.col("o_orderstatus") == "F", "duplicate").otherwise("canonical").alias("duplicate_determination"),
        F.when(F.col("o_orderstatus") == "F", F.when(fifth == 0, F.col("o_orderkey")).when(fifth != 1, F.lit(-1))).alias("canonical_reference_id"),
    )
    return linkage.invalid_decisions(rows).select("reference_id", "reason")


@query("d01_exact_supersets", """WITH i AS (SELECT l_orderkey AS r, l_partkey AS k FROM lineitem GROUP BY ALL)
  SELECT a.r AS reference_id, min(b.r) AS candidate_id FROM
    (SELECT x.r, y.r AS other, count(*) AS n FROM i x JOIN i y ON x.k = y.k AND x.r <> y.r GROUP BY ALL) p
    JOIN (SELECT r, count(*) AS n FROM i GROUP BY r) a ON a.r = p.r AND a.n = p.n JOIN i b ON b.r = p.other GROUP BY a.r""")
def exact_supersets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.lit("doi").alias("identifier_type"), F.col("l_partkey").cast("string").alias("identifier"))
    rows = corpus.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("reference_id")).agg(F.collect_set(one).alias("identifiers"))
    # Written, as both sides read them, more than once.
    rows = lineage.stored(rows.select("*", F.lit("public").alias("visibility"), F.array().cast("array<string>").alias("fingerprints")), "order-contents")
    return linkage.exact_duplicates(rows, rows.withColumn("duplicate_determination", F.lit("canonical")))


@query("a02_pending_counts", f"WITH {corpus.PENDING_SQL} SELECT status, count(*) AS n FROM pending GROUP BY status")
def pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pending(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("j07_retry_depth", f"""WITH RECURSIVE {corpus.PENDING_SQL},
  up AS (SELECT id, retry_of, CASE WHEN retry_of IS NULL THEN 0 ELSE 1 END AS depth FROM pending
    UNION ALL SELECT up.id, p.retry_of, depth + 1 FROM up JOIN pending p ON p.id = up.retry_of WHERE p.retry_of IS NOT NULL)
  SELECT id, max(depth) AS depth FROM up GROUP BY id""")
def retry_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.retry_depths(corpus.pending(spark, sf_dir), "id", "retry_of")


@query("t06_claim", f"""WITH {corpus.PENDING_SQL} SELECT id, reference_id FROM
  (SELECT * FROM pending WHERE robot_id = 7 AND status = 'pending' QUALIFY row_number() OVER (PARTITION BY reference_id ORDER BY created_at, id) = 1) ORDER BY created_at, id LIMIT 20""")
def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workqueue.claim(corpus.pending(spark, sf_dir), 7, 20).select("id", "reference_id")


NOW = "2024-01-15 00:00:00"


@query("t08_expired", f"WITH {corpus.PENDING_SQL} SELECT id, robot_id FROM pending WHERE status = 'processing' AND expires_at < TIMESTAMP '{NOW}'")
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workqueue.expired(corpus.pending(spark, sf_dir), F.expr(f"TIMESTAMP_NTZ '{NOW}'")).select("id", "robot_id")


@query("t09_retries", f"""WITH {corpus.PENDING_SQL}
  SELECT p.reference_id, p.robot_id, p.id AS retry_of, 'pending' AS status FROM pending p LEFT JOIN pending q ON q.id = p.retry_of
  WHERE p.status = 'processing' AND p.expires_at < TIMESTAMP '{NOW}' AND (p.retry_of IS NULL OR q.retry_of IS NULL)""")
def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.pending(spark, sf_dir)
    gone = workqueue.expired(rows, F.expr(f"TIMESTAMP_NTZ '{NOW}'"))
    return workqueue.retries(gone, relational.retry_depths(rows, "id", "retry_of", 3), most=2)


@query("t10_state_machine", f"""WITH {corpus.PENDING_SQL}, m AS (SELECT status AS before, lead(status) OVER (PARTITION BY robot_id ORDER BY created_at, id) AS after FROM pending)
  SELECT before, after, count(*) AS n FROM m WHERE after IS NOT NULL AND NOT (before = 'pending' AND after = 'processing' OR before = 'processing' AND after IN ('importing', 'failed') OR before = 'importing' AND after = 'failed') GROUP BY ALL""")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("robot_id").orderBy("created_at", "id")
    moves = corpus.pending(spark, sf_dir).select(F.col("status").alias("before"), F.lead("status").over(order).alias("after")).where("after is not null")
    return workqueue.illegal(moves, "before", "after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("t11_result_lines", """WITH l AS (SELECT event_id AS line_no, CASE WHEN event_type <> 'error' THEN user_id END AS reference_id, value > 5 AS valid FROM events),
  e AS (SELECT DISTINCT o_custkey AS reference_id FROM orders WHERE o_custkey % 2 = 0), k AS (SELECT l.*, e.reference_id IS NOT NULL AS asked FROM l LEFT JOIN e USING (reference_id))
  SELECT line_no, reference_id, CASE WHEN reference_id IS NULL THEN 'parse_failure' WHEN NOT asked THEN 'not_requested'
    WHEN row_number() OVER (PARTITION BY reference_id ORDER BY line_no) > 1 THEN 'repeated' WHEN NOT coalesce(valid, false) THEN 'invalid' ELSE 'add' END AS outcome FROM k
  UNION ALL SELECT NULL, reference_id, 'missing' FROM e WHERE reference_id NOT IN (SELECT reference_id FROM l WHERE reference_id IS NOT NULL)""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_type") != "error", F.col("user_id")).alias("reference_id"), (F.col("value") > 5).alias("valid"))
    expected = corpus.table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("reference_id"))
    return workqueue.classify_results(lines, expected)


@query("s01_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(corpus.table(spark, sf_dir, "events"), "ts", "event_type")


@query("v05_closure", """WITH RECURSIVE e AS (SELECT n_name AS low, r_name AS high FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  c AS (SELECT low, high FROM e UNION SELECT c.low, e.high FROM c JOIN e ON c.high = e.low) SELECT low, high FROM c""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, supplier = (corpus.table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("low"), F.col("r_name").alias("high"))
    more = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("low"), F.col("n_name").alias("high"))
    return vocabulary.closure(edges.unionByName(more))


@query("v06_coded_concepts", """SELECT l_orderkey AS reference_id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (l_returnflag <> 'N') AS concepts,
    string_agg(DISTINCT 'type ' || p_type, ',' ORDER BY 'type ' || p_type) FILTER (l_returnflag <> 'N') AS labels, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS evaluated
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def coded_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = corpus.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    triples = part.select(F.col("p_type").alias("s"), F.lit(vocabulary.PREF_LABEL).alias("p"), F.concat(F.lit("type "), "p_type").alias("o")).distinct()
    status = F.when(F.col("l_returnflag") == "A", "coded").when(F.col("l_returnflag") == "N", "not_coded")
    coded = corpus.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("reference_id"), F.col("p_brand").alias("property"), F.col("p_type").alias("concept"), status.alias("status"))
    joined = lambda c: F.nullif(F.array_join(c, ","), F.lit("")).alias(c)
    return vocabulary.project(coded, triples).select("reference_id", joined("concepts"), joined("labels"), joined("evaluated"))


@query("snk02_json_lines", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "nation").select(sinks.json_line("n_nationkey", "n_name").alias("line"))


@query("snk03_ris", f"""WITH {corpus.DOCS_SQL}
  SELECT id, 'TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || array_to_string(list_transform(list_sort(brands), lambda b: 'AU  - ' || b), chr(10)) || chr(10) || 'PY  - ' || publication_year || chr(10) || 'ER  - ' AS ris FROM docs""")
def ris(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.order_docs(spark, sf_dir).select("id", "title", F.col("brands").alias("authors"), "publication_year", sinks.ris_type(F.lit("journal")).alias("ris_type"))
    return docs.select("id", sinks.ris_record(docs).alias("ris"))


@query("snk13_digests", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS byte_size, strlen(text) > 5000 AS too_large FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return sinks.digests(rows, "content", 5000).drop("content")


@query("x08_flatten_newlines", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(133), ' '), chr(8232), ' '), chr(8233), ' ')) AS flat FROM documents")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.flatten_newlines(F.col("text")).cast("binary")).alias("flat"))


@query("x11_camel_to_snake", "SELECT DISTINCT event_type AS name, event_type || '_kind' AS snake FROM events")
def camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), text.camel_to_snake(F.concat("event_type", F.lit("Kind"))).alias("snake")).distinct()


@query("x20_year_decay", "SELECT o_orderkey, round(1 + 0.1 * exp(ln(0.5) / 9 * greatest(0.0, abs(year(o_orderdate) - 1995) - 1)), 6) AS factor FROM orders")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", F.round(text.year_decay(F.year("o_orderdate"), F.lit(1995)), 6).alias("factor"))


@query("x25_public_urls", f"""WITH {corpus.IDENTIFIERS_SQL} SELECT reference_id, CASE identifier_type WHEN 'doi' THEN 'https://doi.org/' || identifier WHEN 'pm_id' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || identifier || '/'
  WHEN 'open_alex' THEN 'https://openalex.org/' || identifier END AS url FROM identifiers""")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.page_identifiers(spark, sf_dir).select("reference_id", identifiers.public_url(F.col("identifier_type"), F.col("identifier")).alias("url"))


@query("x27_split_authors", """WITH n AS (SELECT o_orderkey, list_filter(string_split(o_orderpriority || ';' || o_orderstatus || '; ' || o_custkey, ';'), lambda x: true) AS names FROM orders)
  SELECT o_orderkey, trim(names[1]) AS first, trim(names[3]) AS last, len(names) AS n FROM n""")
def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(";", "o_orderpriority", "o_orderstatus", F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    found = corpus.table(spark, sf_dir, "orders").select("o_orderkey", text.split_authors(line).alias("a"))
    at = lambda place: F.get(F.filter("a", lambda x: x["position"] == place), F.lit(0))["display_name"].alias(place)
    return found.select("o_orderkey", at("first"), at("last"), F.size("a").cast("long").alias("n"))


@query("x28_parse_tags", """SELECT o_orderkey, 'priority' AS scheme, o_orderpriority AS label, CASE WHEN o_orderstatus = 'F' THEN 0.25 END AS score FROM orders""")
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit("priority/"), "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "@0.25").otherwise(""))
    return corpus.table(spark, sf_dir, "orders").select("o_orderkey", text.parse_tag(tag).alias("t")).select("o_orderkey", "t.scheme", "t.label", "t.score")
