"""The queries of this folder: op1 to op10 over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from . import language, mixing, quality, secret_scan
from ._common import materialise, table
from .fingerprints import similar_fingerprints
from .jaccard_join import jaccard_join
from .packing import pack_documents
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .vector_dedup import audit_recall, vector_dedup

log = logging.getLogger(__name__)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=200)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), threshold=0.8)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = language.learn(documents, ~language.held_out_fifth())
    return language.identify_languages(documents, net, language.held_out_fifth())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.learn(documents, table(spark, sf_dir, "labels"), ~quality.held_out_third())
    return quality.quality_scores(documents, model, quality.held_out_third())


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    out = materialise(vector_dedup(embeddings, threshold=0.93))
    recall = audit_recall(embeddings, out, threshold=0.93)
    log.log(logging.WARNING if recall < 0.99 else logging.INFO, "op7_vector_dedup: audited recall %.4f", recall)
    return out


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_fingerprints(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_secret_scan, op4_jaccard_join, op5_language, op6_quality, op7_vector_dedup, op8_mixing, op9_fingerprints, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": secret_scan.oracle_sql(), "op8_mixing": mixing.oracle_sql()}
