"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns a DataFrame; all but the last return the columns
of ``documents``. SQL cannot express the stages (a trained classifier, set joins with groups,
BM25, bootstrapped patterns, a tokenizer), so there is no oracle SQL; tests/llm compares a run with
brute force.

Defined results of all stages: rows are judged by themselves, so rows with a null or a repeated id are kept, dropped or redacted
for their own text; a null text is the empty text (and stays null where it is handed on); of rows equal in id and text the second stage
keeps one, unless they have no word; an empty table gives an empty table; extra columns are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontam, jaccard, packing, pii, quality
from pulsegrid.llm.common import bound_batches, drop_saved, read, save


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labels none is rejected."""
    labels = read(spark, sf_dir, "labels")
    if labels.where("quality IS NOT NULL").isEmpty():
        return docs
    return quality.quality(docs, labels).where("predicted = 1").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; documents without a word stay."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in training sequences; an empty text is a piece of the separator."""
    return packing.pack(docs)


def _bounded(stage):
    """The stage with Arrow batches bounded by bytes, also where the caller runs the returned plan."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_filter", _bounded(keep_good)),
    ("near_duplicates", _bounded(keep_one_of_each)),
    ("decontamination", _bounded(drop_leaks)),
    ("personal_data", _bounded(hide_personal_data)),
    ("packing", _bounded(pack_sequences)),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a stored table."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made = save(made, name)
        if k:
            drop_saved(docs)
        docs = made
