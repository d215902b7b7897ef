"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A document is the set of its word trigrams. One hash of each trigram gives both a bin (of ``BINS``) and a value; the least
value of a bin is a MinHash. An empty bin copies a full one that a hash of (bin, attempt) picks, which keeps the chance of
agreement at the Jaccard similarity. ``ROWS`` bins make a band; documents that agree in a band share a bucket. A bucket of
n documents gives n - 1 edges, each to its document of least hash, not n (n - 1) / 2 pairs. Two alike documents share many
buckets, so they are linked unless all of those have hubs that are unlike them. Edges whose signatures agree in less
than ``SIMILARITY`` of the bins go; connected components of the rest are the groups.

A document is a (doc_id, text): rows that repeat both are one document, different texts of one doc_id are different ones.

Results for odd input: a document without words or with a null text is in no group; a null doc_id is an id like any other,
before all others; an empty table gives no groups; extra columns are ignored by ``near_duplicates`` and kept by
``drop_near_duplicates``, which keeps one row of a document's repeated ones, that of the least hash of all columns. The first
document of a group, by doc_id and then by the hash of the text, names it and stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, one_each
from .tokens import U, mix, ngrams, word_hashes

BINS = 128
ROWS = 4
SHINGLE = 3
SIMILARITY = 0.45
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densify(sig: np.ndarray) -> np.ndarray:
    """Fills each empty bin from the full bin that comes first in its own sequence of hashed picks. Rows without a full bin stay."""
    bins = sig.shape[1]
    full = sig != EMPTY
    out = sig.copy()
    row, bin_ = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        pick = (mix(bin_.astype(U) * U(0x9E3779B97F4A7C15) + U(attempt)) % U(bins)).astype(np.int64)
        hit = full[row, pick]
        out[row[hit], bin_[hit]] = sig[row[hit], pick[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def signatures(column, bins: int = BINS, shingle: int = SHINGLE):
    """(first text, signatures) for slices of a string column; a text without words has EMPTY throughout."""
    shift = U(64 - int(bins).bit_length() + 1)
    for first, h, of in word_hashes(column):
        s, s_of = ngrams(h, of, shingle)
        n = len(of) - 1
        sig = np.full(n * bins, EMPTY, U)
        doc = np.repeat(np.arange(n), np.diff(s_of))
        np.minimum.at(sig, doc * bins + (s >> shift).astype(np.int64), s & U(0xFFFFFFFF))
        yield first, densify(sig.reshape(n, bins))


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=U) * U(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r]) + U(r + 1)
    return key.view(np.int64)


def _sign(batches):
    for b in batches:
        for first, sig in signatures(b.column(2)):
            some = np.flatnonzero(sig[:, 0] != EMPTY)
            if not len(some):
                continue
            sig = sig[some]
            keys = band_keys(sig)
            small = (sig & U(0xFF)).astype(np.uint8)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
            own = pa.array(first + some)
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), bands, pa.array([x.tobytes() for x in small], pa.binary())], ["id", "doc_id", "bands", "sig"])


def _agree(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, BINS), np.uint8) for c in (2, 3))
        share = (x == y).mean(1) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array((share - 1 / 256) / (1 - 1 / 256) >= SIMILARITY))


def _identity():
    """A document: the hash of id and text."""
    return F.xxhash64("doc_id", "text")


def sign(docs: DataFrame) -> DataFrame:
    """id, doc_id, bands, sig of every document with a word, once."""
    own = docs.filter(F.col("text").isNotNull()).select(_identity().alias("id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = materialise(own.mapInArrow(_sign, "id long, doc_id long, bands array<long>, sig binary"), "signatures")
    again = materialise(signed.groupBy("id").count().filter("count > 1").select("id"), "again")
    if again.isEmpty():
        return signed
    return materialise(signed.join(again, "id", "left_anti").union(signed.join(again, "id", "left_semi").select(signed.columns).dropDuplicates(["id"])), "signatures")


def edges(signed: DataFrame) -> DataFrame:
    """Verified edges (u, v), u < v; u is the hub of a bucket."""
    banded = signed.select("id", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("id").alias("u"), F.max("id").alias("last")).filter("u < last").select("band", "u")
    pairs = materialise(banded.join(hubs, "band").filter("u < id").select("u", F.col("id").alias("v")).distinct(), "candidates")
    sig = signed.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("u"), F.col("sig").alias("x")), "u").join(sig.select(F.col("id").alias("v"), F.col("sig").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(_agree, "u long, v long")


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) for every vertex of the edges (u, v), u < v: alternating large-star and small-star until nothing changes.

    Every edge ends at its component's least vertex. Each round is a written table, so lineage doesn't grow.
    """
    pairs, before = materialise(pairs, "edges"), None
    while True:
        sums = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if sums == before:
            return pairs.select(F.col("v").alias("id"), F.col("u").alias("root")).union(pairs.select("u", "u").distinct())
        before = sums
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.col("m").alias("u"), "v").union(small.filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        pairs = materialise(small, "edges")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The verified edges, and id, doc_id, first and group_id of every document that has one: the first of its group by doc_id, nulls before others, then by hash."""
    signed = sign(docs)
    linked = materialise(edges(signed), "links")
    found = materialise(components(linked).join(signed.select("id", "doc_id"), "id"), "groups")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("first"))
    return linked, found.join(first, "root").select("id", "doc_id", F.col("first.id").alias("first"), F.col("first.doc_id").alias("group_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the doc_id of the group's first document) and n_links (verified edges) of every document that has a near copy."""
    linked, found = _grouped(docs)
    ends = linked.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    return found.join(ends, "id").select("doc_id", "group_id", "n_links")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without those of a group that aren't its first. Only rows that repeat a document are shuffled with their texts."""
    keyed = docs.withColumn("__ll_id", _identity())
    gone = materialise(_grouped(docs)[1].filter("id <> first").select(F.col("id").alias("__ll_id")), "copies")
    again = materialise(keyed.groupBy("__ll_id").count().filter("count > 1").select("__ll_id").join(gone, "__ll_id", "left_anti"), "repeats")
    once = keyed.join(gone.union(again), "__ll_id", "left_anti")
    if again.isEmpty():
        return once.select(*docs.columns)
    return once.union(one_each(keyed.join(again, "__ll_id", "left_semi"), ["__ll_id"], docs.columns).select(once.columns)).select(*docs.columns)
