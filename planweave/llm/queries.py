"""Queries of the corpus operators, as registered by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planweave.llm.common import table
from planweave.llm import fingerprint, html, langid, lm, media, mixing, ngram_join, pii, repeats
from planweave.llm.packing import pack


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows behind the digest of ``op1_media``."""
    return media.clips(media.store(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assignments(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, media_clips, op2_pii, op3_mixing, op4_repeats, op5_lm_score, op6_fingerprint, op7_ngram_join, op8_html, op9_packing, op10_langid)}


#: Near groups as SQL: distinct shingles, pairs that share one, links, and the least id that each document reaches.
_NEAR_GROUPS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)])
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams
  FROM w
), g AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS shared
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs WHERE 100 * shared >= 80 * (total - shared)
  UNION ALL SELECT y, x FROM pairs WHERE 100 * shared >= 80 * (total - shared)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id FROM s JOIN least USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_join": _NEAR_GROUPS}
