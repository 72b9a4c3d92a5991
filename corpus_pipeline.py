"""A training corpus from raw documents, in five stages.

Each stage takes what the one before it kept. All but the last return the
columns of ``documents``; the last adds each copy's number and its place in
the shuffled order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urbandemand.llm.common import dropped, stored, table
from urbandemand.llm.decontamination import without_contaminated
from urbandemand.llm.exact_dedup import without_copies
from urbandemand.llm.mixing import mix_sources
from urbandemand.llm.near_dedup import without_near_duplicates
from urbandemand.llm.quality import fit_quality, without_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return without_rejected(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The quality classifier is not a thing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored for the next.

    A stage's table is dropped when the next one is written; the last one's
    rows are read by the result.
    """
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if n:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
