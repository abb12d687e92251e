"""The registered queries of this package's operators, and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import alignment, bpe, byte_bpe, decontaminate, filter_audit, line_dedup, quality, sharding, simhash, suffix_dedup, topk, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.array_join(F.array_sort("removed"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    done = bpe.decode(bpe.encode(docs, tokenizer_path), tokenizer_path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), word_tokenizer())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), left.alias("text"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("has_repeats"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failure_masks(table(spark, sf_dir, "documents"))
    return filter_audit.audit(masks, table(spark, sf_dir, "labels"))


def alignment_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    a, b = (Path(public_tokenizers.path(name)).read_bytes() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    done = alignment.align(docs, a.decode(), b, public_tokenizers.PATTERN)
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return done.withColumn("groups_sha256", digest).drop("groups")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"))


def byte_bpe_digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    done = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern), ranks)
    spelled = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return byte_bpe_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_topk": op9_topk,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_alignment": op12_alignment,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE: dict[str, str] = {
    "op11_filter_audit": """
        WITH t AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w
          FROM documents
        ), m AS (
          SELECT doc_id, part,
            CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
              || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
              || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
              || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
              || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
          FROM t
        ), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        c AS (
          SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
          FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails
        ), f(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (
          SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a JOIN f b ON b.l <> a.l JOIN f c ON c.l NOT IN (a.l, b.l)
          JOIN f d ON d.l NOT IN (a.l, b.l, c.l) JOIN f e ON e.l NOT IN (a.l, b.l, c.l, d.l)
        ), s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS letter FROM o, range(1, 6) r(step)),
        p AS (
          SELECT s.*, c.*, contains(fails, letter) AS failing,
            coalesce(list_min(list_filter(range(1, 6), lambda i: contains(fails, filter_order[i:i]))), 9) AS hit
          FROM s, c
        ), r AS (
          SELECT part, filter_order, step, any_value(letter) AS letter,
            coalesce(sum(n) FILTER (hit > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit = step), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (failing AND hit < step), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (hit = step), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (hit = step), 0)::BIGINT AS toxic_lost
          FROM p GROUP BY part, filter_order, step
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
          (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM r
    """,
    "op5_decontamination": """
        WITH w AS (
          SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents
          UNION ALL
          SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') FROM benchmark
        ), s AS (
          SELECT DISTINCT kind, id, unnest(list_transform(generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
          FROM w WHERE len(w) > 0
        ), sizes AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, any_value(z.n) AS n_shingles, count(*) AS n_shared, round(count(*) / any_value(z.n), 6) AS containment
        FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.shingle = i.shingle JOIN sizes z ON z.id = i.id
        GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(z.n)
    """,
    "op9_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op7_url_filter": """
        WITH RECURSIVE rules(verdict, rhost, rpath) AS (
          VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                 ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
        ), p AS (
          SELECT page_id, url, html,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages
        ), tags AS (
          SELECT url, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*(?:rel\\s*=\\s*["'']?canonical|http-equiv\\s*=\\s*["'']?refresh)[^>]*>')) AS tag
          FROM p
        ), targets AS (
          SELECT url, path, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site,
            replace(regexp_extract(tag, '(?is)(?:href\\s*=\\s*["'']?|content\\s*=\\s*["'']?[^"''>]*url\\s*=\\s*''?)([^"''>\\s]+)', 1), '&amp;', '&') AS t
          FROM tags WHERE contains(url, '://')
        ), joined AS (
          SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
            WHEN starts_with(t, '/') THEN site || t WHEN starts_with(t, '?') THEN site || path || t
            ELSE site || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || t END AS t, starts_with(t, '?') AS same_path
          FROM targets WHERE t <> '' AND NOT starts_with(t, '#') AND (regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') OR NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:'))
        ), parts AS (
          SELECT url, same_path, regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS raw, regexp_extract(t, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)?', 1) AS q
          FROM joined
        ), undotted AS (
          SELECT url, h, q, CASE WHEN same_path OR raw = '' THEN raw ELSE list_reduce(string_split(raw, '/'), lambda done, x: CASE WHEN x = '.' THEN done WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || x END)
            || CASE WHEN regexp_matches(raw, '/\\.\\.?$') THEN '/' ELSE '' END END AS path FROM parts
        ), edges AS (
          SELECT translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(10) || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)?', 1) AS a,
            translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(10) || coalesce(nullif(path, ''), '/') || q AS b
          FROM undotted
        ), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
        reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
        nodes AS (SELECT b AS node, split_part(b, chr(10), 1) AS host, split_part(substr(b, instr(b, chr(10)) + 1), '?', 1) AS path FROM (SELECT DISTINCT b FROM reach)),
        judged AS (
          SELECT host, path, rhost || rpath AS rule, verdict FROM (SELECT host, path FROM p UNION SELECT host, path FROM nodes) u
          JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
          QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, verdict) = 1
        ), passed AS (
          SELECT r.a, CASE WHEN bool_or(j.verdict = 'allow') THEN 'allow' WHEN bool_or(j.verdict = 'block') THEN 'block' END AS verdict
          FROM reach r JOIN nodes n ON n.node = r.b LEFT JOIN judged j ON j.host = n.host AND j.path = n.path GROUP BY r.a
        )
        SELECT p.page_id, p.host, p.path, j.rule, coalesce(j.verdict, a.verdict, 'allow') AS verdict
        FROM p LEFT JOIN judged j ON j.host = p.host AND j.path = p.path
        LEFT JOIN passed a ON contains(p.url, '://') AND a.a = p.host || chr(10) || coalesce(nullif(p.path, ''), '/') || regexp_extract(p.url, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)?', 1)
    """,
}
