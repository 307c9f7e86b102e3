"""The queries of this subpackage: one per operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_schedule

    return mix_schedule(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents, train

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projections import nearest_by_cosine

    return nearest_by_cosine(_table(spark, sf_dir, "embeddings"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_repeated_lines

    kept = drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5")
    )


def op6_gram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grams import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivots import top_inner_products

    return top_inner_products(_table(spark, sf_dir, "embeddings"))


def op8_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .idcodec import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_scores": op2_quality_scores,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_personal_data": op4_personal_data,
    "op5_line_dedup": op5_line_dedup,
    "op6_gram_join": op6_gram_join,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_binary_ids": op8_binary_ids,
    "op9_pack_sequences": op9_pack_sequences,
    "op10_warc_normalise": op10_warc_normalise,
}

OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM s),
f AS (
  SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / sum(w) OVER after AS level,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM w
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (
  SELECT source, source_size, least(cap, (SELECT min_by(level, k) FROM f WHERE level * w <= cap) * w) AS target FROM f),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (
  SELECT total, greatest(1, least(2048, total // 8192)) AS block, CAST(ceil(total / block) AS BIGINT) AS n
  FROM (SELECT CAST(sum(floor(target)) AS BIGINT) AS total FROM t)),
i AS (
  SELECT source, source_size, CAST(floor(target) AS BIGINT) AS quota, round((upto - target) / whole * 2147483648) AS lo,
         round(upto / whole * 2147483648) AS hi
  FROM (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST) AS upto, greatest(sum(target) OVER (), 1.0::DOUBLE) AS whole FROM t)),
g AS (
  SELECT i.source, slot, row_number() OVER (PARTITION BY i.source ORDER BY slot) - 1 AS rank
  FROM (SELECT unnest(range(n)) AS slot FROM b) JOIN i ON (slot % 2147483648) * 1327217885 % 2147483648 >= lo AND (slot % 2147483648) * 1327217885 % 2147483648 < hi),
x AS (
  SELECT p.*, CAST(greatest(0, least(start + size, quota) - start)
            + greatest(0, least(start + size, quota - source_size) - start) AS BIGINT) AS taken, start // block AS place, n
  FROM p, b)
SELECT doc_id, CAST(size AS BIGINT) AS size, x.source_size, target, taken,
       CAST(CASE WHEN taken > 0 THEN coalesce(slot, n + place) END AS BIGINT) AS first_slot
FROM x LEFT JOIN g ON x.source IS NOT DISTINCT FROM g.source AND x.place = g.rank
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS z
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (
  SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
d AS (
  SELECT p.page_id, p.payload, f.first,
         list_transform(string_split(sha1(p.payload), ''), lambda c: strpos('0123456789abcdef', c) - 1) AS h
  FROM p JOIN f USING (payload))
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((((h[(5 * i) // 4 + 1] * 16 + coalesce(h[(5 * i) // 4 + 2], 0)) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS INT) + 1, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

SQL = {
    "op7_exact_top_k": OP7_SQL,
    "op10_warc_normalise": OP10_SQL,
    "op1_mix_sources": OP1_SQL,
}
