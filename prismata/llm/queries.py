"""The ``opN_<name>`` queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_template, importance, jaccard_join, mixing, oracles, oracles_more, packing, pu_quality, quality_rules, reply_trees, secret_scan, simhash, suffix_dedup, toxicity, vector_codes
from .common import table


#: Target weights of the mixture; every other source weighs 1.
TARGETS = {"src0": 4}


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mixture by ``TARGETS``."""
    return mixing.schedule(table(spark, sf_dir, "documents"), TARGETS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document."""
    return quality_rules.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, with the digest of the base ones."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without strings of 200 bytes that occur elsewhere."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_template.extract(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 4,096 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one chain of replies, formatted and read back."""
    return reply_trees.report(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the word distribution of ``benchmark``."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every embedding, with the codebooks' digest."""
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op4_pu_quality": op4_pu_quality,
    "op5_source_mixing": op5_source_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash": op8_simhash,
    "op9_html_template": op9_html_template,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_reply_trees": op11_reply_trees,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.JACCARD,
    "op2_secret_scan": oracles.secrets(),
    "op7_suffix_dedup": oracles_more.repeats(),
    "op11_reply_trees": oracles_more.conversations(),
    "op12_importance_resampling": oracles_more.resampling(),
    "op13_vector_codes": oracles_more.vectors(),
}
