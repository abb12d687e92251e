"""Bibliographic corpora derived from the star-schema tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as search documents: lines' parts are concepts, suppliers' nations are countries.

    Children are grouped before they are joined to the order, so no join multiplies rows.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_linenumber", "l_shipdate")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_name")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name", "r_name")
    wide = lines.join(parts, "l_partkey").join(suppliers, "l_suppkey")
    grouped = wide.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("p_type")).alias("types"),
        F.array_sort(F.collect_set("p_brand")).alias("brands"),
        F.array_sort(F.collect_set("p_name")).alias("names"),
        F.array_sort(F.collect_set("n_name")).alias("countries"),
        F.array_sort(F.collect_set("r_name")).alias("regions"),
        F.round(F.max("l_discount") * 10, 4).alias("inclusion_score"),
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(grouped, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"),
        F.array_join("names", " ").alias("title"),
        F.year("o_orderdate").alias("publication_year"),
        F.array(F.concat(F.lit("status/"), "o_orderstatus"), F.concat(F.lit("priority/"), "o_orderpriority")).alias("annotations"),
        "types",
        "brands",
        "countries",
        "regions",
        "inclusion_score",
        F.col("o_totalprice").alias("price"),
    )


DOCS_SQL = """docs AS (
  SELECT o_orderkey AS id, names AS title, CAST(year(o_orderdate) AS INTEGER) AS publication_year,
    ['status/' || o_orderstatus, 'priority/' || o_orderpriority] AS annotations,
    types, brands, countries, regions, inclusion_score, o_totalprice AS price
  FROM orders JOIN (
    SELECT l_orderkey, list(DISTINCT p_type) AS types, list(DISTINCT p_brand) AS brands,
      string_agg(DISTINCT p_name, ' ' ORDER BY p_name) AS names, list(DISTINCT n_name) AS countries,
      list(DISTINCT r_name) AS regions, round(max(l_discount) * 10, 4) AS inclusion_score
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY l_orderkey) ON o_orderkey = l_orderkey
)"""


def document_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as references: title is the first line, abstract the text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"), "lang", "source")


REFS_SQL = "refs AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, lang, source FROM documents)"


def line_enhancements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as metadata layers of their order, in the order of ship date, then unique keys."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("reference_id"),
        F.col("l_shipdate").alias("created_at"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]).alias("tie"),
        F.when(F.col("l_returnflag") == "R", "bibliographic").when(F.col("l_returnflag") == "A", "abstract").otherwise("annotation").alias("enhancement_type"),
        F.col("l_linenumber").alias("number"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("tax "), F.col("l_tax").cast("string"))).alias("note"),
        F.when(F.col("l_discount") > 0.03, F.col("l_partkey")).otherwise(F.lit(0).cast("long")).alias("part"),
        F.concat(F.lit("mode "), F.col("l_linestatus")).alias("scheme"),
    )


LAYERS_SQL = """layers AS (
  SELECT l_orderkey AS reference_id, l_shipdate AS created_at,
    l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS VARCHAR) AS tie,
    CASE l_returnflag WHEN 'R' THEN 'bibliographic' WHEN 'A' THEN 'abstract' ELSE 'annotation' END AS enhancement_type,
    l_linenumber AS number, l_quantity AS quantity,
    CASE WHEN l_tax > 0.02 THEN 'tax ' || CAST(l_tax AS VARCHAR) END AS note,
    CASE WHEN l_discount > 0.03 THEN l_partkey ELSE 0 END AS part, 'mode ' || l_linestatus AS scheme
  FROM lineitem
)"""


def order_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and priority as stars: the least key is canonical, others duplicate it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    least = orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("canonical"))
    linked = F.col("o_orderkey") != F.col("canonical")
    return orders.join(least, ["o_custkey", "o_orderpriority"]).select(
        F.col("o_orderkey").alias("reference_id"),
        F.lit(True).alias("active_decision"),
        F.when(linked, "duplicate").otherwise("canonical").alias("duplicate_determination"),
        F.when(linked, F.col("canonical")).alias("canonical_reference_id"),
    )


DECISIONS_SQL = """decisions AS (
  SELECT o_orderkey AS reference_id, CASE WHEN o_orderkey = c THEN 'canonical' ELSE 'duplicate' END AS duplicate_determination,
    CASE WHEN o_orderkey <> c THEN c END AS canonical_reference_id
  FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS c FROM orders)
)"""


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pending enhancements; an error's next event of the same user retries it."""
    from pyspark.sql import Window

    kinds = {"signup": "pending", "view": "processing", "click": "importing", "purchase": "completed", "error": "failed"}
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()])
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("status", status)
    retried = F.when(F.lag("status").over(order) == "failed", F.lag("event_id").over(order))
    return rows.select(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 500).alias("reference_id"),
        F.col("user_id").alias("robot_id"),
        "status",
        F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("expires_at"),
        retried.alias("retry_of"),
    )


PENDING_SQL = """pending AS (
  SELECT event_id AS id, event_id % 500 AS reference_id, user_id AS robot_id, status, ts AS created_at, ts + INTERVAL 10 MINUTE AS expires_at,
    CASE WHEN lag(status) OVER w = 'failed' THEN lag(event_id) OVER w END AS retry_of
  FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'importing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""


def page_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls as identifiers, without scheme, query, fragment and endings; types by page_id."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), r"(/|\.html)$", "")
    kind = F.when(F.col("page_id") % 5 == 0, "doi").when(F.col("page_id") % 5 == 1, "open_alex").when(F.col("page_id") % 5 == 2, "other").otherwise("pm_id")
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 100).alias("reference_id"), kind.alias("identifier_type"), plain.alias("identifier"), F.when(kind == "other", "url").alias("other_identifier_name"))


IDENTIFIERS_SQL = """identifiers AS (
  SELECT page_id % 100 AS reference_id,
    CASE page_id % 5 WHEN 0 THEN 'doi' WHEN 1 THEN 'open_alex' WHEN 2 THEN 'other' ELSE 'pm_id' END AS identifier_type,
    regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '(/|\\.html)$', '') AS identifier,
    CASE WHEN page_id % 5 = 2 THEN 'url' END AS other_identifier_name
  FROM pages
)"""
