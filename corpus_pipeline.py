"""A corpus pipeline: language, near copies, personal data, mixing, packing.

Each stage takes all that the one before it kept. Between stages the documents are written as Parquet and read again, so a stage's
decisions are made once and its lineage is cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm import langid, mixing, ngram_join, packing, pii
from planweave.llm.common import pinned, stored

#: The share of tokens that mixing keeps.
KEPT_TOKENS = 0.8
#: No SQL: stages 1, 3 and 4 rest on trained or iterated models; tests hold each stage against a plain computation.
ORACLE_SQL = None


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the classifiers know."""
    return langid.accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id. Null ids stay; rows that share an id leave one."""
    groups = pinned(ngram_join.near_groups(docs))
    staying = groups.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(staying, "doc_id", "left_semi")
    n, ids = groups.select(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n != ids:
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    return pii.redact(docs)


def in_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents in which sources, languages and topics near their target shares."""
    return mixing.mixed(docs, KEPT_TOKENS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", with_language),
    ("near_copies", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mixing", in_target_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
