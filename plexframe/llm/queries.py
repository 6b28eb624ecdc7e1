"""The queries of the corpus operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .language_id import held_out, identify, learn
from .license_scan import scan_licenses
from .line_dedup import line_dedup, line_runs
from .pieces import encode
from .sharding import rendezvous, shard_shuffle
from .token_counts import count_tokens
from .warc import round_trip

SHARDS, SEED = 8, 20177


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    place = F.struct("_metadata.file_name", "_metadata.row_index")  # the same wherever the table is copied
    out = shard_shuffle(docs, SHARDS, seed=SEED, salt=place)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    grown = rendezvous(F.col("doc_id"), SHARDS + 1, SEED)
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text"), check=True)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_line_dedup holds to the chunks of its SQL; this one takes whole runs, as the pipeline does."""
    return line_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_shards, op2_language_id, op3_sentencepiece, op4_decontaminate, op5_exact_dedup, op6_license_scan, op7_jaccard_join, op8_line_dedup, op9_warc, op10_token_counts, op8_line_runs)}


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM w
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS shared
  FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM met WHERE 100 * shared >= 85 * (nx + ny - shared)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id FROM sets s JOIN least l ON s.doc_id = l.x
"""

OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), hashed AS (
  SELECT *, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::UBIGINT::BIGINT) AS h,
         list_transform(l, lambda x: length(x) - length(replace(x, ' ', '')) >= 50) AS big
  FROM lines
), ended AS (
  SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR big[i] OR big[least(i + 1, len(l))]
           OR (h[i] * 31 + CASE WHEN i = 1 THEN 0 ELSE h[greatest(i - 1, 1)] END) % 3 = 0) AS e
  FROM hashed
), chunks AS (
  SELECT doc_id, text, l, big, e, unnest(range(1, len(e) + 1)) AS k FROM ended
), bodies AS (
  SELECT doc_id, k, len(e) AS n_chunks, CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END AS a, e[k] AS b, l, big FROM chunks
), cut AS (
  SELECT doc_id, k, n_chunks, array_to_string(l[a:b], chr(10)) AS body, (b > a OR big[b]) AS able FROM bodies
), marked AS (
  SELECT *, able AND (doc_id, k) <> (first_value(doc_id) OVER w, first_value(k) OVER w) AS gone
  FROM cut WINDOW w AS (PARTITION BY body, able ORDER BY doc_id, k)
), joined AS (
  SELECT doc_id, max(n_chunks) AS n_chunks, sum(gone::INT) AS n_removed, string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.kept, '') END AS text,
       coalesce(j.n_chunks, 0)::BIGINT AS n_chunks, coalesce(j.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS main FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> main THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> main THEN main END AS refers_to
FROM w
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_line_dedup": OP8_SQL, "op9_warc": OP9_SQL}


__all__ = ["oracle_sql", "queries"]
