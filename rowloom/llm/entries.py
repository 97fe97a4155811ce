"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm.classifiers import quality, toxicity
from rowloom.llm.ctw import lm_scores
from rowloom.llm.decontaminate import contaminated
from rowloom.llm.embedding_dedup import embedding_dedup
from rowloom.llm.html_extract import extract
from rowloom.llm.licenses import license_scan
from rowloom.llm.licenses import sql as licenses_sql
from rowloom.llm.mixing import mix
from rowloom.llm.mixing import sql as mixing_sql
from rowloom.llm.near_dedup import near_dedup
from rowloom.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=2, threshold=0.8)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL
), iw AS (
  SELECT row_number() OVER () AS item, item_id, w FROM (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
), i AS (
  SELECT DISTINCT item, item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
  FROM iw WHERE len(w) > 0
), n AS (
  SELECT item, item_id, count(*) AS n FROM i GROUP BY item, item_id
), l AS (
  SELECT DISTINCT len(string_split(g, ' ')) AS len FROM i
), d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - l.len + 2), lambda k: array_to_string(w[k:k + l.len - 1], ' '))) AS g
  FROM dw CROSS JOIN l
), p AS (
  SELECT d.doc_id, i.item, count(*) AS c FROM d JOIN i USING (g) GROUP BY ALL
)
SELECT doc_id, item_id, c AS n_shared, n AS n_item, round(c / n, 9) AS containment
FROM p JOIN n USING (item) WHERE 100 * c >= 80 * n
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), d AS (
  SELECT page_id, n, sha256(html) AS digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS origin FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> origin THEN origin END AS refers_to
FROM f
"""


def queries() -> dict:
    found = (op1_mixing, op2_embedding_dedup, op3_license_scan, op4_decontaminate, op5_minhash_dedup, op6_html_extract, op7_toxicity, op8_quality, op9_warc, op10_lm_scores)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing_sql(), "op3_license_scan": licenses_sql(), "op4_decontaminate": OP4_SQL, "op9_warc": OP9_SQL}
