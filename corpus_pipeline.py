"""A training corpus from raw documents: quality, repeated lines, near copies, benchmark passages, packing.

Every stage works on all documents that the one before it kept, and all but the last return the columns of ``documents``.
Odd input (nulls in any column, empty or very long texts, repeated rows, empty tables, extra columns) has the results that
the operators' modules define; extra columns pass through to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, lines, neardup, packing, quality
from spanloom.llm.shared import made, materialise, sweep, table

#: Hashed n-gram models, MinHash components and proximity can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resample rejects go."""
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that occurs more than once all but the first go; so do documents of which only copied lines were left."""
    return lines.filter_lines(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id stays."""
    return neardup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a phrase of a benchmark item, or its rare terms close together, go."""
    return decontam.filter_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows' segments."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. What a stage wrote on the way, and its input, go when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), made(spark)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, f"stage{n}")
            sweep(spark, before, docs)
    return docs
