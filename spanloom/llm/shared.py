"""Helpers shared by the training-data operators: the shared folder and materialised tables.

Internal columns are named ``__ll_*`` so that extra input columns of any ordinary name can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources.files import Files, scratch

P = "__ll_"


#: Paths made by ``scratch_path`` and not deleted yet, by application.
_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    path = scratch(spark, f"llm-{name}")
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> set[str]:
    """The paths of the tables that operators have written in this application and that aren't deleted yet."""
    return set(_made.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, before: set[str], keep: DataFrame) -> None:
    """Deletes the tables made since ``before`` but the one that ``keep`` reads. For the end of a step whose result is written."""
    read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()}
    for path in made(spark) - before:
        folder, _, name = path.rpartition("/")
        if name not in read:
            Files(spark, folder).delete(name)
            _made[spark.sparkContext.applicationId].remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(col: str = "text"):
    """64-bit identity of a text; null has its own."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("\x00null")))


def one_each(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row of those that agree in ``key``: that of the least hash of all ``columns``, so which one doesn't depend on order."""
    w = W.partitionBy(*key).orderBy(F.xxhash64(F.to_json(F.struct(*columns))))
    return df.withColumn(f"{P}row", F.row_number().over(w)).filter(f"{P}row = 1").drop(f"{P}row")
