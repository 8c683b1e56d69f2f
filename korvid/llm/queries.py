"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvid.llm import bpe, decontaminate, exact, html, lines, near, quality, secrets, suffix, warc
from korvid.llm.common import owned

QUERIES: dict = {}
ORACLE: dict = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = owned(f)
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


@_query(
    "op6_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
           sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    WINDOW w AS (PARTITION BY t)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(_read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_table(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query(
    "op1_warc_dictionary",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (
      SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS keep,
             array_to_string(list_transform(range(1, 41), lambda i: to_base(strpos('0123456789abcdef', substr(sha1(h), i, 1)) - 1, 2, 4)), '') AS bits
      FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
             + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
           CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
    FROM d
    """,
)
def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(_read(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")))


@_query("op2_quality_bradley_terry")
def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), held_out=2)


@_query("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), words=4)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


@_query("op9_suffix_repeats")
def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


@_query(
    "op3_line_winnowing",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    l AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS ln FROM d),
    f AS (
      SELECT *, len(regexp_extract_all(x, '[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]+')) AS n, row_number() OVER (PARTITION BY doc_id, t ORDER BY ln) AS i
      FROM l WHERE length(trim(x)) > 0),
    w AS (
      SELECT doc_id, t, i, x || chr(10) || lead(x) OVER o || chr(10) || lead(x, 2) OVER o AS g, [ln, lead(ln) OVER o, lead(ln, 2) OVER o] AS lns
      FROM f WINDOW o AS (PARTITION BY doc_id, t ORDER BY ln)
      UNION ALL SELECT doc_id, t, i, CASE WHEN n + lead(n) OVER o >= 50 THEN x || chr(10) || lead(x) OVER o END AS g, [ln, lead(ln) OVER o] AS lns
      FROM f WINDOW o AS (PARTITION BY doc_id, t ORDER BY ln)
      UNION ALL SELECT doc_id, t, i, x AS g, [ln] AS lns FROM f WHERE n >= 50),
    r AS (SELECT doc_id, t, lns, row_number() OVER (PARTITION BY g, len(lns) ORDER BY doc_id NULLS LAST, i) AS k FROM w WHERE g IS NOT NULL),
    gone AS (SELECT DISTINCT doc_id, t, unnest(lns) AS ln FROM r WHERE k > 1),
    kept AS (
      SELECT l.doc_id, l.t, count(*) AS n_lines, count(gone.ln) AS n_removed,
             coalesce(string_agg(CASE WHEN gone.ln IS NULL THEN l.x END, chr(10) ORDER BY l.ln), '') AS rest
      FROM l LEFT JOIN gone USING (doc_id, t, ln) GROUP BY l.doc_id, l.t)
    SELECT doc_id, n_lines, n_removed, sha256(rest) AS kept_sha256 FROM kept
    """,
)
def op3_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@_query("op5_pigeonhole_decontamination")
def op5_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@_query("op4_html_main_text")
def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))
