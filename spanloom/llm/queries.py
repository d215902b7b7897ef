"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lines, neardup, packing, quality, sharding, tiff, tokencounts, toxicity
from .shared import materialise, scratch_path, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op4_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


#: Decoration that the revised texts of op6 are free of.
MARKS = r"[*#$%&]{3}|!!|\|"


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents come, those labelled toxic go, texts with decoration are counted anew without it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    counts = materialise(tokencounts.token_counts(docs), "token-counts")
    store = tokencounts.RollupStore(spark, scratch_path(spark, "rollups"))
    store.commit("load", tokencounts.inserts(counts))
    store.commit("retract", tokencounts.deletes(counts.join(toxic, "doc_id", "left_semi")))
    revised = tokencounts.revised_counts(docs.filter(F.col("text").rlike(MARKS)), F.regexp_replace("text", MARKS, ""))
    store.commit("revise", tokencounts.revisions(revised.join(toxic, "doc_id", "left_anti")))
    return store.totals()


def op7_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so each embedding is rendered as a TIFF of four pages first. SQL can't say bytes, so the samples' sums stand for them."""
    return tiff.pages(tiff.rendered(table(spark, sf_dir, "embeddings")), pixels=False)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_quality_resample": op4_quality_resample,
    "op5_language": op5_language,
    "op6_token_rollups": op6_token_rollups,
    "op7_shuffled_shards": op7_shuffled_shards,
    "op8_toxicity": op8_toxicity,
    "op9_tiff_pages": op9_tiff_pages,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLE = {
    "op1_line_dedup": lines.SQL,
    "op2_packing": packing.SQL,
    "op9_tiff_pages": tiff.SQL,
}
