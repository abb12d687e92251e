"""Registered queries of search, facets, finds and finds' limits, each with the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import facets, linkage, relational, search, standing
from quillspark.plans import corpus

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Words of a text in DuckDB, as ``functions.text.tokens`` cuts them.
TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def _orders(sql: str) -> str:
    return f"WITH {corpus.DOCS_SQL} {sql}"


def _refs(sql: str) -> str:
    return f"WITH {corpus.REFS_SQL} {sql}"




def recent() -> search.Query:
    return search.Query(search.term("title", "red"), (("year", search.between("publication_year", 1994, 1998)),))


RECENT_SQL = f"list_contains({TOKENS.format('title')}, 'red') AND publication_year BETWEEN 1994 AND 1998"


@query("q01_search_page", _orders(f"SELECT id, publication_year, title FROM docs WHERE {RECENT_SQL} ORDER BY publication_year DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20"))
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(corpus.order_docs(spark, sf_dir), recent(), ["-publication_year"], page=2).select("id", "publication_year", "title")


@query("q03_default_fields", _refs(f"SELECT id, lang FROM refs WHERE list_contains({TOKENS.format('title')}, 'this') OR list_contains({TOKENS.format('abstract')}, 'this')"))
def default_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_refs(spark, sf_dir).where(search.any_term(["title", "abstract"], "this")).select("id", "lang")


@query("q03_wildcard", _refs(f"SELECT id FROM refs WHERE len(list_filter({TOKENS.format('abstract')}, lambda t: regexp_full_match(t, 'th.*on'))) > 0"))
def wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_refs(spark, sf_dir).where(search.wildcard("abstract", "th*on")).select("id")


@query("q03_prefix", _refs(f"SELECT id FROM refs WHERE len(list_filter({TOKENS.format('title')}, lambda t: starts_with(t, 'ther'))) > 0"))
def prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_refs(spark, sf_dir).where(search.prefix("title", "ther")).select("id")


#: Words that a neighbouring pair's change of places makes of a word.
_TURNED = "list_transform(range(1, len({0})), lambda i: {0}[:i - 1] || {0}[i + 1] || {0}[i] || {0}[i + 2:])"


# DuckDB's distance counts bytes: what isn't ASCII stands for one other character.
@query("q03_fuzzy", _refs(f"""
  , turned AS (SELECT {_TURNED.format("'thation'")} AS once), twice AS (SELECT once, flatten(list_transform(once, lambda w: {_TURNED.format("w")})) AS more FROM turned),
  ws AS (SELECT id, unnest(list_transform({TOKENS.format('title')}, lambda t: regexp_replace(t, '[^ -~]', '#', 'g'))) AS t FROM refs)
  SELECT DISTINCT id FROM ws, twice WHERE levenshtein(t, 'thation') <= 2 OR list_contains(more, t) OR len(list_filter(once, lambda w: levenshtein(t, w) <= 1)) > 0"""))
def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_refs(spark, sf_dir).where(search.fuzzy("title", "thation")).select("id")


@query("q03_phrase", _refs(f"SELECT id FROM refs WHERE contains(' ' || array_to_string({TOKENS.format('abstract')}, ' ') || ' ', ' of the ')"))
def phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_refs(spark, sf_dir).where(search.phrase("abstract", "of the")).select("id")


@query("q04_count", _orders(f"SELECT count(*) AS total FROM docs WHERE {RECENT_SQL}"))
def exact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count(corpus.order_docs(spark, sf_dir), recent())


@query("q05_scan_pages", _orders("SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 500 + 1 AS INTEGER) AS page FROM docs WHERE publication_year >= 1994"))
def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scan(corpus.order_docs(spark, sf_dir), search.Query(search.between("publication_year", 1994)), "id").select("id", "page")


@query("l03_result_window", "SELECT least(count(*), 10000) AS total, count(*) > 10000 AS is_lower_bound FROM orders WHERE o_totalprice >= 1000")
def result_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.capped_total(corpus.table(spark, sf_dir, "orders"), search.Query(search.between("o_totalprice", 1000)))


@query("l04_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.after(corpus.table(spark, sf_dir, "orders"), search.Query(F.col("o_orderstatus") == "F"), "o_orderkey", 1000, 50).select("o_orderkey", "o_custkey")


@query("f01_year_range", _orders("SELECT id, publication_year FROM docs WHERE publication_year BETWEEN 1993 AND 1995"))
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.order_docs(spark, sf_dir).where(search.between("publication_year", 1993, 1995)).select("id", "publication_year")


@query("f02_annotation_term", _orders("SELECT id FROM docs WHERE list_contains(annotations, 'status/F')"))
def annotation_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.order_docs(spark, sf_dir).where(search.annotation("status", "F")).select("id")


@query("f03_annotation_scheme", _orders("SELECT count(*) AS n FROM docs WHERE len(list_filter(annotations, lambda a: starts_with(a, 'priority/'))) > 0"))
def annotation_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count(corpus.order_docs(spark, sf_dir), search.Query(search.annotation("priority"))).withColumnRenamed("total", "n")


@query("f04_annotation_score", _orders("SELECT id, inclusion_score FROM docs WHERE inclusion_score >= 0.8"))
def annotation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.order_docs(spark, sf_dir)
    return docs.where(search.annotation("inclusion:score", score=0.8, columns=docs.columns)).select("id", "inclusion_score")


@query("f05_concepts_countries", _orders("SELECT id FROM docs WHERE list_has_any(types, ['ECONOMY', 'SMALL']) AND list_has_any(countries, ['NATION_3', 'NATION_4'])"))
def concepts_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = (("types", search.holds_any("types", ["ECONOMY", "SMALL"])), ("countries", search.holds_any("countries", ["NATION_3", "NATION_4"])))
    return corpus.order_docs(spark, sf_dir).where(search.Query(filters=filters).predicate()).select("id")


@query("f08_without_own_filter", _orders("SELECT count(*) AS n FROM docs WHERE list_has_any(countries, ['NATION_3'])"))
def without_own_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search.Query(filters=(("types", search.holds("types", "SMALL")), ("countries", search.holds("countries", "NATION_3"))))
    return corpus.order_docs(spark, sf_dir).where(asked.predicate(without="types")).agg(F.count(F.lit(1)).alias("n"))


@query("a07_terms_facet", _orders(f"""
  , rows AS (SELECT 'types' AS field, unnest(types) AS value FROM docs WHERE {RECENT_SQL}
    UNION ALL SELECT 'countries', unnest(countries) FROM docs WHERE {RECENT_SQL})
  SELECT field, value, count(*) AS n FROM rows GROUP BY field, value QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 10"""))
def terms_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.terms(corpus.order_docs(spark, sf_dir), recent(), ["types", "countries"], 10)


SIBLINGS = [(["NATION_1"], ["NATION_1", "NATION_2"]), (["NATION_3"], ["NATION_3", "NATION_4"])]


@query("a08_sibling_facet", _orders("""
  , v AS (SELECT unnest(countries) AS value, countries, publication_year >= 1995 AS hit FROM docs)
  SELECT 0 AS "group", value, count(*) FILTER (hit AND list_contains(countries, 'NATION_3')) AS n FROM v WHERE value IN ('NATION_1', 'NATION_2') GROUP BY value
  UNION ALL SELECT 1, value, count(*) FILTER (hit AND list_contains(countries, 'NATION_1')) FROM v WHERE value IN ('NATION_3', 'NATION_4') GROUP BY value
  UNION ALL SELECT -1, value, count(*) FILTER (hit AND list_contains(countries, 'NATION_1') AND list_contains(countries, 'NATION_3')) AS n
    FROM v WHERE value NOT IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') GROUP BY value HAVING n > 0"""))
def sibling_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.sibling_terms(corpus.order_docs(spark, sf_dir), search.Query(search.between("publication_year", 1995)), "countries", SIBLINGS)


@query("a09_universal_siblings", _orders("""
  , v AS (SELECT unnest(countries) AS value, publication_year >= 1995 AS hit FROM docs)
  SELECT 0 AS "group", value, count(*) FILTER (hit) AS n FROM v GROUP BY value"""))
def universal_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.sibling_terms(corpus.order_docs(spark, sf_dir), search.Query(search.between("publication_year", 1995)), "countries", [(["NATION_1"], None)])


@query("a10_cross_facet", _orders("""
  SELECT v0, v1, count(*) AS n, (SELECT count(*) FROM docs) AS search_total,
    (SELECT count(*) FROM docs WHERE len(regions) > 0 AND len(types) > 0) AS mapped_total
  FROM (SELECT v0, unnest(types) AS v1 FROM (SELECT unnest(regions) AS v0, types FROM docs)) GROUP BY v0, v1"""))
def cross_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.cross(corpus.order_docs(spark, sf_dir), search.Query(), "regions", "types")


@query("a01_count", "SELECT count(*) AS total FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count(corpus.table(spark, sf_dir, "lineitem"), search.Query())


@query("f09_find", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 100")
def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.find(corpus.table(spark, sf_dir, "orders"), "o_orderkey", 100, o_orderstatus="O", o_orderpriority="2-HIGH").select("o_orderkey", "o_totalprice")


@query("f10_any_of", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = corpus.table(spark, sf_dir, "part").where("p_size > 40").select("p_partkey")
    return relational.any_of(corpus.table(spark, sf_dir, "lineitem"), "l_partkey", large).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f11_missing", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus.table(spark, sf_dir, "lineitem").select("l_orderkey")
    return relational.missing(ids, corpus.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("src11_partition_bounds", """
  SELECT tile, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n_rows
  FROM (SELECT o_orderkey, ntile((SELECT (count(*) + 999) // 1000 FROM orders)) OVER (ORDER BY o_orderkey) AS tile FROM orders) GROUP BY tile""")
def partition_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.partition_boundaries(corpus.table(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query("snk04_upsert", "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done, count(*) AS n FROM orders GROUP BY o_custkey")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    fresh = orders.where("o_orderstatus = 'F'").withColumn("done", F.lit(1))
    return relational.upsert(orders.withColumn("done", F.lit(0)), fresh, "o_orderkey").groupBy("o_custkey").agg(F.sum("done").alias("done"), F.count(F.lit(1)).alias("n"))


@query("snk06_insert_ignore", "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = corpus.table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey")
    return relational.insert_ignore(there, corpus.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("snk08_bulk_update", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'L' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return relational.bulk_update(orders, F.col("o_totalprice") > 250000, o_orderstatus="L").drop("o_totalprice")


@query("u01_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = corpus.table(spark, sf_dir, "orders")
    keys = lambda status: relational.find(orders, o_orderstatus=status).select("o_custkey")
    return keys("F").intersectAll(keys("O"))


@query("d06_bm25_top_k", _refs(f"""
  , docs AS (SELECT id, {TOKENS.format('title')} AS ws FROM refs),
  stats AS (SELECT count(*) AS n_docs, avg(len(ws)) AS avgdl FROM docs),
  idx AS (SELECT id, word, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(ws) AS dl, unnest(ws) AS word FROM docs) GROUP BY id, word),
  df AS (SELECT word, count(*) AS df FROM idx GROUP BY word),
  q AS (SELECT item_id AS query_id, greatest(1, floor(0.5 * len(ws))) AS need, unnest(ws) AS word FROM (SELECT item_id, list_distinct({TOKENS.format('text')}) AS ws FROM benchmark)),
  s AS (SELECT q.query_id, idx.id, round(sum(2.0 * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM q JOIN df USING (word) CROSS JOIN stats JOIN idx USING (word) WHERE q.query_id <> idx.id
    GROUP BY q.query_id, idx.id HAVING count(*) >= any_value(need))
  SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""))
def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return linkage.bm25_top_k(asked, corpus.document_refs(spark, sf_dir)).select("query_id", "id", "score", "rank")


def registered() -> dict:
    return {"dear": F.col("price") > 300000, "green": search.term("title", "green") & search.holds("types", "SMALL"), "early": search.between("publication_year", high=1995)}



@query("t13_standing_queries", _orders(f"""
  SELECT 'dear' AS robot, id FROM docs WHERE price > 300000
  UNION ALL SELECT 'green', id FROM docs WHERE list_contains({TOKENS.format('title')}, 'green') AND list_contains(types, 'SMALL')
  UNION ALL SELECT 'early', id FROM docs WHERE publication_year <= 1995"""))
def standing_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standing.match(corpus.order_docs(spark, sf_dir), registered(), "id")


@query("a13_dispatch", _orders("SELECT 'early' AS robot, count(*) AS n, min(id) AS least FROM docs WHERE publication_year <= 1995 HAVING count(*) > 0"))
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = {k: registered()[k] for k in ("dear", "early")}
    sent = standing.dispatch(standing.match(corpus.order_docs(spark, sf_dir), only, "id"), "id", skip_robot="dear")
    return sent.groupBy("robot").agg(F.sum(F.size("references")).alias("n"), F.min(F.array_min("references")).alias("least"))
