"""Documents to packed training windows, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import jaccard, packing, secrets, substrings, toxicity
from tallybook.llm.shared import read, staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the held-out fold, accepts."""
    return toxicity.accepted(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by five-word shingles go; the smallest id of each group stays."""
    return jaccard.representatives(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that start at another place too go; the documents stay."""
    return substrings.shortened(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; the documents stay."""
    return secrets.cleaned(docs, secrets.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training window."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("substring_dedup", remove_repeated_passages),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]
#: Trained models, similarity groups and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's rows are staged before the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
