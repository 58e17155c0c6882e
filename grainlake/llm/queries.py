"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, table, word_count
from .fingerprint import compare_versions
from .jaccard import jaccard_components
from .linededup import drop_boilerplate, host_of, html_lines
from .mixing import mix
from .packing import concatenate_and_cut
from .secrets import scan_versions
from .tokencount import count_tokens
from .topk import top_k
from .toxicity import fit, score
from .warc import round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS rep
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> rep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> rep THEN rep END AS refers_to
FROM d
"""


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents")).withColumnRenamed("edited", "edited_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(table(spark, sf_dir, "documents"), new_path(spark, "ledger"), "doc_id")
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *map(count, ("assign", "access", "hex")), F.sha2(shown, 256).alias("base_sha256"), shown.alias("spans"))


def op5_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where(F.col("doc_id") % 20 == 0))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
meets AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m, count(*) AS common
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id AND b.n * 100 >= a.n * 90 AND a.n * 100 >= b.n * 90
  GROUP BY ALL),
links AS (SELECT x, y FROM meets WHERE 100 * common >= 90 * (n + m - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x)
SELECT r.doc_id, len(s)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach r JOIN sets USING (doc_id) GROUP BY r.doc_id, s
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('1:', coalesce(doc_id::VARCHAR, ''))) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
  FROM docs GROUP BY source),
weighed AS (
  SELECT source, s, (place - 1) % 3 + 1 AS w, 3 * s AS cap FROM sources),
summed AS (
  SELECT *, sum(s) OVER () AS total,
    sum(cap) OVER (ORDER BY cap / w, w, s ROWS UNBOUNDED PRECEDING) AS caps,
    sum(w) OVER (ORDER BY cap / w, w, s ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER () AS weights
  FROM weighed),
levels AS (
  SELECT *, (total - (caps - cap))::DOUBLE / (weights - upto + w)::DOUBLE AS level FROM summed),
targets AS (
  SELECT source, s, CASE WHEN cap >= level * w THEN max(CASE WHEN cap >= level * w THEN level END) OVER () * w
                    ELSE cap::DOUBLE END AS target
  FROM levels),
epochs AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, e.s, e.target, e.whole, round(e.target - e.whole * e.s)::BIGINT AS last,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM docs d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, s AS source_size, target,
  (whole * size + greatest(0, least(size, last - start)))::BIGINT AS taken
FROM placed
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.coalesce("html", F.lit(""))).alias("before"))
    pages = materialise(pages, "page-lines")  # tags are taken out once, for both passes
    cut = drop_boilerplate(pages.withColumn("text", F.col("before")), F.col("host"))
    lines = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")).cast("long")
    return cut.select("page_id", "host", lines("before").alias("n_lines"), (lines("before") - lines("text")).alias("n_dropped"), "text")


OP8_SQL = r"""
WITH pages2 AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:p|br|li|ul|ol|div|h[1-6]|article|nav|header|footer|section|aside|main|title|table|tr|td|th|head|body|html|pre|blockquote|hr)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), '[\t\x20]*\n[\t\x20\n]*', chr(10), 'g'), chr(10)) AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM pages2 GROUP BY host),
often AS (
  SELECT host, line FROM (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM pages2) JOIN totals USING (host)
  WHERE trim(line) <> '' GROUP BY host, line, pages HAVING count(*) > 0.1::DOUBLE * pages AND count(*) >= 3),
bad AS (SELECT host, list(line) AS b FROM often GROUP BY host),
cut AS (
  SELECT page_id, host, list_filter(lines, lambda x: trim(x) <> '') AS had,
    list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(b, []), x)) AS kept
  FROM pages2 LEFT JOIN bad USING (host))
SELECT page_id, host, len(had)::BIGINT AS n_lines, (len(had) - len(list_filter(kept, lambda x: trim(x) <> '')))::BIGINT AS n_dropped,
  array_to_string(kept, chr(10)) AS text
FROM cut
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", "p_toxic", (F.col("p_toxic") > 0.5).alias("toxic"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = concatenate_and_cut(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {f.__name__: f for f in (op1_warc, op2_fingerprints, op3_token_counts, op4_secret_scan, op5_bm25_top_k, op6_jaccard_join, op7_mixing, op8_line_dedup, op9_toxicity, op10_packing)}

ORACLE_SQL = {"op1_warc": OP1_SQL, "op6_jaccard_join": OP6_SQL, "op7_mixing": OP7_SQL, "op8_line_dedup": OP8_SQL}
