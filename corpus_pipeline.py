"""A training corpus out of `documents`: STAGES in their order, each over all that the one before kept.

run() writes every stage's rows to the shared folder and reads them back, so a stage is judged, redone
and its lineage cut on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeingraph.llm.common import materialize, read
from skeingraph.llm.decontaminate import decontaminate
from skeingraph.llm.language import keep_identified, train_on_documents
from skeingraph.llm.packing import pack_documents
from skeingraph.llm.simhash import keep_first
from skeingraph.llm.substring import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows; those that it rejects go."""
    return keep_identified(docs, train_on_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of the smallest id."""
    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages of 50 words and more that a document of a smaller id has."""
    return remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in training sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Fingerprints, matching statistics and tokenizing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
