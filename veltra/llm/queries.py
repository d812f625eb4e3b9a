"""The contract queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veltra.llm import embeddings, mixing, neardup, packing, quality, secrets, substrings, tokenfiles, toxicity, warc
from veltra.llm.common import default_tokenizer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), default_tokenizer())


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op4_duplicate_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_spans")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_token_files(tokenfiles.write_token_files(table(spark, sf_dir, "documents"), default_tokenizer()))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 says of the base kinds, which SQL can say too."""
    return op10_secret_scan(spark, sf_dir).drop("spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 counts in each text, which SQL can count too."""
    return op7_quality_rules(spark, sf_dir).drop("kept", "score")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op6, without what the draws decide."""
    return op6_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_near_duplicates, op3_warc, op4_duplicate_substrings, op5_toxicity, op6_mix_sources, op7_quality_rules, op8_near_vectors, op9_token_files, op10_secret_scan, secrets_base, quality_base, mix_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op8_near_vectors": OP8_SQL, "secrets_base": SECRETS_SQL, "quality_base": QUALITY_SQL, "mix_targets": TARGETS_SQL}


OP3_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, url FROM f
"""

#: Matches and the gaps between them give the spans.
SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p(rank, kind, pattern) AS (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')),
m AS (SELECT doc_id, rank, kind, list_transform(regexp_extract_all(t, pattern), lambda x: length(x)) AS hits, regexp_extract_all(t, pattern) AS texts,
             list_transform(string_split_regex(t, pattern), lambda x: length(x)) AS gaps FROM d, p),
n AS (SELECT doc_id, rank, kind, hits, texts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT doc_id, rank, kind, texts[i] AS found, hits[i] AS size, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i-1]), 0) AS BIGINT) AS start FROM n),
k AS (SELECT * FROM s WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(found, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6
                                      WHEN 'access' THEN size >= 20 ELSE size >= 24 END),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) AS listed FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

#: Words in windows of eight that a text holds twice, counted once each.
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(0, 8) AS x(j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       coalesce(h.n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(h.n, 0) > 30 * len(ws) AS base_failed
FROM w LEFT JOIN h ON h.doc_id = w.doc_id
"""

#: The excess of full sources is handed on until none is left.
TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
f(step, source, n, w, is_full) AS (
  SELECT 0, source, n, w, FALSE FROM s
  UNION ALL
  SELECT step + 1, source, n, w, is_full OR (sum(n) OVER () - coalesce(sum(CASE WHEN is_full THEN 3 * n END) OVER (), 0)) * w / sum(CASE WHEN NOT is_full THEN w END) OVER () > 3 * n
  FROM f WHERE step < (SELECT count(*) FROM s)),
z AS (SELECT source, n, CASE WHEN is_full THEN 3.0 * n ELSE (sum(n) OVER () - coalesce(sum(CASE WHEN is_full THEN 3 * n END) OVER (), 0)) * w / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target
      FROM f WHERE step = (SELECT count(*) FROM s))
SELECT d.doc_id, d.size, z.n AS source_size, round(CAST(z.target AS DOUBLE), 3) AS target FROM d JOIN z ON z.source IS NOT DISTINCT FROM d.source
"""

#: Links by brute force over all pairs of a label; components by repeated minimum over linked vectors.
OP8_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT x.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id, x.vec_id = m.component_id AS kept
FROM embeddings x JOIN m ON m.id = x.vec_id LEFT JOIN n ON n.a = x.vec_id
"""
