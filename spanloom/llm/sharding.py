"""Two-pass external shuffle of a corpus into shards.

Pass one scatters records uniformly into buckets that fit a task's memory, by a seeded hash of the whole record: the
shuffle files are the external storage. Pass two shuffles each bucket by Fisher-Yates, driven by splitmix64 of seed and
bucket, and writes it. A bucket is put in order by record hash before that, so a retried task, other executors or another
input order give the same shards. Records in random buckets in random order are a uniform shuffle.

A record that repeats more than ``REPEATS`` times is counted first, then written out again from its count in numbered
copies, ``CHUNK`` to a task; a copy's number is part of its hash, so the copies scatter as different records do.

Results for odd input: nulls are values like any other; repeated rows each stay; an empty table gives no rows; extra
columns are kept (maps can't be hashed and raise Spark's error). Input columns named shard_id or shard_pos are replaced.
One record larger than a bucket makes a bucket of that size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise
from .tokens import U, mix

BUCKET_BYTES = 48 << 20
SEED = 20_240_101
REPEATS, CHUNK = 1000, 100_000


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """The permutation of n places: for i from n - 1 down to 1, swap i with a random place up to i."""
    start = mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], U) ^ mix(np.array([bucket + 1], U)))[0]
    draws = mix(start + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    upto = np.arange(n, 0, -1, dtype=U)[: max(0, n - 1)]
    js = ((draws[: len(upto)] >> U(11)).astype(float) * 2.0**-53 * upto.astype(float)).astype(np.int64).tolist()
    p = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), js):
        p[i], p[j] = p[j], p[i]
    return np.array(p, np.int64)


def _shuffler(seed: int, names: list[str]):
    def run(batches):
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.concat_tables(parts)
        del parts
        bucket = table.column("__ll_bucket")[0].as_py()
        order = np.lexsort((table.column("__ll_h2").to_numpy(), table.column("__ll_h").to_numpy()))
        take = order[fisher_yates(len(order), seed, bucket)]
        table = table.select(names)
        for a in range(0, len(take), 1000):
            rows = table.take(pa.array(take[a : a + 1000])).combine_chunks()
            n = rows.num_rows
            rows = rows.append_column("shard_id", pa.array(np.full(n, bucket, np.int32))).append_column("shard_pos", pa.array(np.arange(a, a + n)))
            yield from rows.to_batches()

    return run


def _copies(keyed: DataFrame, seed: int) -> DataFrame:
    """Repeated records from their counts, each copy with hashes of its own."""
    counted = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("__ll_n"))
    chunks = counted.withColumn("__ll_chunk", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__ll_n") - 1).cast("long"), F.lit(CHUNK).cast("long"))))
    spread = chunks.repartition("__ll_h", "__ll_chunk").withColumn("__ll_copy", F.explode(F.sequence("__ll_chunk", F.least(F.col("__ll_chunk") + CHUNK, "__ll_n") - 1)))
    own = {c: F.xxhash64(F.lit(seed), c, "__ll_copy") for c in ("__ll_h", "__ll_h2")}
    return spread.withColumns(own).select(keyed.columns)


def shuffle(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, repeats: int = REPEATS) -> DataFrame:
    """All records with shard_id and shard_pos; a partition is a shard, in order."""
    names = [c for c in docs.columns if c.lower() not in ("shard_id", "shard_pos")]
    docs = docs.select(*names)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    h, h2 = F.xxhash64(F.lit(seed), *names), F.xxhash64(F.lit(seed + 1), *names)
    keyed = docs.select("*", h.alias("__ll_h"), h2.alias("__ll_h2"))
    hot = materialise(keyed.groupBy("__ll_h", "__ll_h2").count().filter(F.col("count") > repeats).select("__ll_h", "__ll_h2"), "repeats")
    if not hot.isEmpty():
        keyed = keyed.join(hot, ["__ll_h", "__ll_h2"], "left_anti").select(keyed.columns).union(_copies(keyed.join(hot, ["__ll_h", "__ll_h2"], "left_semi").select(keyed.columns), seed))
    keyed = keyed.withColumn("__ll_bucket", F.pmod(F.shiftrightunsigned("__ll_h", 20), F.lit(buckets)).cast("int"))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard_id", T.IntegerType()), T.StructField("shard_pos", T.LongType())])
    return keyed.repartitionById(buckets, F.col("__ll_bucket")).mapInArrow(_shuffler(seed, names), schema)


def write_shards(docs: DataFrame, path: str, **params) -> DataFrame:
    """Writes the shards, a file each, and reads them back. A task that is retried writes the same file; the commit takes one."""
    out = shuffle(docs, **params)
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
