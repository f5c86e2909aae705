"""Corpus pipeline: documents in, the plan of packed training sequences out.

``run`` tells the place of every piece of every kept document; ``sequences``
gives the token ids of each sequence, from the masked texts.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's ``docs``, so a lost executor costs a
stage at most and no lineage runs through two stages.

Defined cases: a document with a null or empty text fails the quality rules and
goes; null doc_ids, nulls in other columns, repeated rows and extra columns go
through all stages but the last, whose rows are pieces of documents; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismata.llm import common, jaccard_join, mixing, packing, quality_rules, secret_scan
from prismata.llm.queries import TARGETS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.accept(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return jaccard_join.one_per_class(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order in which sources mix to their target weights; the stored table keeps it."""
    return mixing.mixed(docs, TARGETS)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence; stretches of the stored order are packed one after the other."""
    return packing.packed_in_order(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing to target weights", mixture),
    ("best-fit packing", packing_plan),
]

#: The verdicts of the first stage and the plan of the last are beyond SQL.
ORACLE_SQL: str | None = None


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages but the last leave of ``documents``, stored in the order of the mixture; earlier stages' tables are deleted."""
    docs, before = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for _, stage in STAGES[:-1]:
        here = common.Scratch(spark)
        docs = here.saved(stage(spark, docs, sf_dir), small=True)  # texts lie on the disk beside those that the next stage shuffles
        before.release()
        before = here
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, prepared(spark, sf_dir), sf_dir)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence_id, ids, doc_ids: the sequences themselves."""
    return packing.sequences(prepared(spark, sf_dir))
