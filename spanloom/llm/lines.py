"""Line dedup with a sharded minimal perfect hash.

Every distinct line hash of the corpus belongs to one of the shards. A shard is a minimal perfect hash function over its
line hashes (levels of bit arrays, about 3 bits a line) that indexes compact arrays: a 16-bit fingerprint, a count and
the first place of the line. Documents send the hashes of their lines to the shards, probe the arrays there and get back
the numbers of the lines to drop; no line text is shuffled or joined. Shards that many lines probe (a line that millions
of documents share) are replicated in proportion, so no task gets more than about ``PROBES`` of them.

A line counts as itself without surrounding blanks. Of a line that occurs ``min_count`` times or more, all but the first
occurrence (by doc_id, nulls first, then place in the text) go; lines under ``min_chars`` characters always stay.

Results for odd input: null text stays null with 0 lines; empty text has one line and keeps it; rows that repeat both
doc_id and text are one document and come out once; a null doc_id is an id like any other; an empty table gives an empty
result; extra columns are ignored by ``dedup_lines`` and kept by ``filter_lines`` (of repeated rows that differ in them the
one of the least hash of all columns). Two lines whose 64-bit hashes collide
share a slot; the one whose fingerprint is not stored is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, one_each
from .tokens import U, mix

MIN_CHARS = 20
MIN_COUNT = 2
SHARD_BYTES = 256 << 20
PROBES = 1_000_000
#: Text for one task where texts are shuffled, if the session's number of partitions would give it more.
TASK_BYTES = 64 << 20
GAMMA = 2
BLANKS = " \t\r"


class PerfectHash:
    """Minimal perfect hash over distinct uint64 keys: each level keeps the keys that have a bit to themselves."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.first = np.cumsum(sizes) - sizes
        self.rank = np.cumsum(bits, dtype=np.int64) - bits

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, level = [], [], 0
        while len(keys):
            size = max(8, GAMMA * len(keys))
            at = cls._place(keys, level, size)
            counts = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(counts == 1)
            keys = keys[counts[at] > 1]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; for a key that isn't in the set any index or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.first[level] + self._place(keys[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        s = np.frombuffer(sizes, np.int64)
        return cls(s, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(s.sum())).astype(bool))


def occurrences(docs: DataFrame, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line that can be dropped: its document's key, number, 64-bit hash, fingerprint and shard."""
    line = F.expr(f"trim(BOTH '{BLANKS}' FROM __ll_line)")
    rows = docs.select("doc_id", "__ll_key", "__ll_key2", F.posexplode(F.split("text", "\n")).alias("__ll_pos", "__ll_line")).withColumn("__ll_line", line)
    rows = rows.filter(F.length("__ll_line") >= min_chars).withColumn("k", F.xxhash64("__ll_line"))
    return rows.select("doc_id", "__ll_key", "__ll_key2", "__ll_pos", "k", F.hash("__ll_line").bitwiseAND(0xFFFF).alias("f"), F.pmod("k", F.lit(shards)).cast("int").alias("shard"))


INDEX = "shard int, n long, probes long, sizes binary, bits binary, fingerprints binary, counts binary, first_key binary, first_pos binary"


def _build(table: pa.Table) -> pa.Table:
    col = lambda c: table.column(c).to_numpy()
    keys = col("k").view(U)
    mphf = PerfectHash.build(keys)
    at = mphf.lookup(keys)

    def put(c: str, kind) -> bytes:
        out = np.zeros(len(keys), kind)
        out[at] = col(c)
        return out.tobytes()

    sizes, bits = mphf.dump()
    row = {"shard": int(col("shard")[0]), "n": len(keys), "probes": int(col("n").sum()), "sizes": sizes, "bits": bits, "fingerprints": put("f", np.uint16), "counts": put("n", np.int64), "first_key": put("first_key", np.int64), "first_pos": put("first_pos", np.int32)}
    return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("probes", pa.int64()), *((c, pa.binary()) for c in ("sizes", "bits", "fingerprints", "counts", "first_key", "first_pos"))]))


def build_index(lines: DataFrame) -> DataFrame:
    """One row for each shard: the perfect hash and its arrays."""
    first = F.min(F.struct("doc_id", "__ll_key", "__ll_pos"))
    distinct = lines.groupBy("shard", "k").agg(F.min("f").alias("f"), F.count("*").alias("n"), first.alias("at"))
    flat = distinct.select("shard", "k", "f", "n", F.col("at.__ll_key").alias("first_key"), F.col("at.__ll_pos").alias("first_pos"))
    return flat.groupBy("shard").applyInArrow(_build, INDEX)


def probe(row: dict, keys: np.ndarray, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, count) of each line hash in a shard; slot -1 and count 0 where the fingerprint shows that it isn't there."""
    slot = PerfectHash.load(row["sizes"], row["bits"]).lookup(keys)
    known = slot >= 0
    known[known] = np.frombuffer(row["fingerprints"], np.uint16)[slot[known]] == fingerprints[known]
    counts = np.zeros(len(keys), np.int64)
    counts[known] = np.frombuffer(row["counts"], np.int64)[slot[known]]
    return np.where(known, slot, -1), counts


DROPS = pa.schema([("__ll_key", pa.int64()), ("__ll_key2", pa.int32()), ("__ll_pos", pa.int32())])


def _dropper(min_count: int):
    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not probes.num_rows or not index.num_rows:
            return DROPS.empty_table()
        row = index.to_pylist()[0]
        col = lambda c: probes.column(c).to_numpy()
        slot, count = probe(row, col("k").view(U), col("f").astype(np.uint16))
        many = np.flatnonzero(count >= min_count)
        s = slot[many]
        first = (np.frombuffer(row["first_key"], np.int64)[s] == col("__ll_key")[many]) & (np.frombuffer(row["first_pos"], np.int32)[s] == col("__ll_pos")[many])
        many = many[~first]
        return pa.table([pa.array(col(c)[many], DROPS.field(c).type) for c in DROPS.names], schema=DROPS)

    return run


def _drops(lines: DataFrame, index: DataFrame, min_count: int) -> DataFrame:
    """The lines to drop: document keys and line numbers."""
    copies = index.select("shard", F.ceil(F.col("probes") / PROBES).cast("int").alias("copies"))
    hot = copies.filter("copies > 1")
    copy = F.coalesce(F.pmod("__ll_key", "copies"), F.lit(0)).cast("int").alias("copy")
    left = lines.join(hot, "shard", "left").select("shard", copy, "__ll_key", "__ll_key2", "__ll_pos", "k", "f")
    right = index.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("probes") / PROBES).cast("int") - 1)).alias("copy"))
    return left.groupBy("shard", "copy").cogroup(right.groupBy("shard", "copy")).applyInArrow(_dropper(min_count), "__ll_key long, __ll_key2 int, __ll_pos int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__ll_key": F.xxhash64("doc_id", "text"), "__ll_key2": F.hash("text", "doc_id")})


def mark(docs: DataFrame, min_count: int = MIN_COUNT, min_chars: int = MIN_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each document once, with __ll_lines (array) and __ll_keep (numbers of the lines that stay)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = _keyed(docs)
    lines = materialise(occurrences(keyed, max(1, -(-size // shard_bytes)), min_chars), "lines")
    index = materialise(build_index(lines), "line-index")
    drops = materialise(_drops(lines, index, min_count).groupBy("__ll_key", "__ll_key2").agg(F.collect_set("__ll_pos").alias("__ll_drop")), "line-drops")
    key = ["__ll_key", "__ll_key2"]
    again = materialise(keyed.groupBy(*key).count().filter("count > 1").select(*key), "line-repeats")
    if not again.isEmpty():
        keyed = keyed.join(again, key, "left_anti").select(keyed.columns).union(one_each(keyed.join(again, key, "left_semi"), key, docs.columns).select(keyed.columns))
    tasks = -(-size // TASK_BYTES)
    if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        keyed = keyed.repartition(tasks, *key)
    return keyed.join(drops, key, "left")


def _parts(marked: DataFrame) -> DataFrame:
    lines = F.split("text", "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size("__ll_lines") - 1), "__ll_drop")
    marked = marked.withColumn("__ll_lines", lines)
    return marked.withColumn("__ll_kept", F.when(F.col("__ll_drop").isNull(), F.col("__ll_lines")).otherwise(F.transform(keep, lambda i: F.get("__ll_lines", i))))


def dedup_lines(docs: DataFrame, **params) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines (before) and n_dropped of every document."""
    n = F.coalesce(F.size("__ll_lines"), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    out = _parts(mark(docs.select("doc_id", "text"), **params))
    text = F.when(F.col("__ll_drop").isNull(), F.col("text")).otherwise(F.array_join("__ll_kept", "\n"))
    return out.select("doc_id", text.alias("text"), n.cast("long").alias("n_lines"), F.when(F.col("__ll_drop").isNull(), 0).otherwise(F.size("__ll_drop")).cast("long").alias("n_dropped"))


def filter_lines(docs: DataFrame, min_chars: int = MIN_CHARS, **params) -> DataFrame:
    """The documents without the dropped lines (n_chars, where there is one, is counted anew).

    A document that loses lines and keeps none of ``min_chars`` characters is only copies, and goes.
    """
    out = _parts(mark(docs, min_chars=min_chars, **params))
    left = F.exists("__ll_kept", lambda x: F.length(F.trim(x)) >= min_chars)
    text = F.when(F.col("__ll_drop").isNull(), F.col("text")).otherwise(F.array_join("__ll_kept", "\n"))
    out = out.filter(F.col("__ll_drop").isNull() | left).withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__ll_drop").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM l),
m AS (SELECT *, length(body) >= 20 AND row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, pos) > 1 AS gone FROM t)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM m GROUP BY doc_id, whole
UNION ALL SELECT doc_id, text, 0, 0 FROM d WHERE text IS NULL
"""
