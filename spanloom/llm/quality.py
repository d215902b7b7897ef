"""Quality classifier by importance resampling.

Two generative models over hashed n-grams of words and punctuation runs (uni- and bigrams in ``n_buckets`` buckets, additive smoothing): one of
the target text (documents labelled good), one of the raw text (all documents). A document's log weight is the sum over
its n-grams of log target - log raw. The k documents of largest log weight + Gumbel noise are the resample, which is
sampling k documents without replacement in proportion to their weights. The others are rejected.

Results for odd input: a document with null or empty text has log weight 0; a null doc_id is an id like any other;
repeated rows get the same weight and noise (the noise is a seeded hash of doc_id and text), so they are kept or
rejected together and the sample may exceed k by repeats of its last document. Ties are broken by doc_id, nulls last.
Without labelled target rows both models are equal: every weight is 0 and the sample is uniform. An empty table gives an
empty result. Extra columns are ignored by the operator and kept by ``filter_quality``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .tokens import U, ngrams, word_hashes

N_BUCKETS = 1 << 16
#: At most so many labelled documents are used, taken by the hash of their ids: the good ones fit the target model, and both kinds set k.
MAX_LABELS = 30_000
#: Added to a bucket's count in the target and to the count that the raw model expects there: little evidence gives a ratio near 1.
SMOOTHING = 4.0
SEED = 17


def features(column, n_buckets: int = N_BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bucket of each uni- and bigram, the text of each) for slices of a string column."""
    for first, h, of in word_hashes(column, punctuation=True):
        uni = (h & U(n_buckets - 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
        h2, of2 = ngrams(h, of, 2, seed=1)
        many = np.repeat(np.diff(of) > 1, np.diff(of2))
        bi = (h2 & U(n_buckets - 1)).astype(np.int64)[many]
        yield first, np.concatenate((uni, bi)), np.concatenate((doc, np.repeat(np.arange(len(of2) - 1), np.diff(of2))[many]))


def _count(ids: np.ndarray, n_buckets: int):
    def run(batches):
        raw, target = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            key = batch.column(0)
            good = np.isin(key.fill_null(0).to_numpy(zero_copy_only=False), ids) & key.is_valid().to_numpy(zero_copy_only=False)
            for first, bucket, doc in features(batch.column(1), n_buckets):
                raw += np.bincount(bucket, minlength=n_buckets)
                target += np.bincount(bucket[good[first + doc]], minlength=n_buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    return run


def labelled(labels: DataFrame, most: int = MAX_LABELS) -> dict[int, int]:
    """The bounded sample of labelled rows, by the hash of doc_id: doc_id to quality (an id labelled twice counts as bad)."""
    one = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return {i: q for i, q in one.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most).collect()}


def target_ids(known: dict[int, int]) -> list[int]:
    """Two of three good documents fit the target model; the rest are held out to set the cut."""
    return [i for n, i in enumerate(i for i, q in known.items() if q == 1) if n % 3]


def fit(docs: DataFrame, known: dict[int, int], n_buckets: int = N_BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log target - log raw for each bucket. One pass over the text; ``n_buckets`` rows reach the driver."""
    ids = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(target_ids(known), np.int64)))
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    counts = docs.select("doc_id", "text").mapInArrow(_lazy_count(ids, n_buckets), "bucket long, raw long, target long")
    for bucket, r, t in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(n_buckets)
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + smoothing) - np.log(expected + smoothing)


def _lazy_count(ids, n_buckets: int):
    return lambda batches: _count(ids.value, n_buckets)(batches)


def weigh(column, ratio: np.ndarray) -> np.ndarray:
    """The log weight of each text of a string column."""
    out = np.zeros(len(column))
    for first, bucket, doc in features(column, len(ratio)):
        if len(doc):
            part = np.bincount(doc, ratio[bucket])
            out[first : first + len(part)] = part
    return out


def _key(weight: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """log weight + Gumbel noise from 64 random bits, rounded so that summation order can't matter."""
    u = ((bits.astype(np.int64).view(U) >> U(11)).astype(float) + 0.5) * 2.0**-53
    return np.round(weight - np.log(-np.log(u)), 9) + 0.0


def noise():
    """64 bits that depend on the row alone."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(SEED))


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight and sort_key (log weight + noise) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for b in batches:
            w = weigh(b.column(1), model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w), pa.array(_key(w, b.column(2).to_numpy(zero_copy_only=False)))], ["doc_id", "log_weight", "sort_key"])

    return docs.select("doc_id", "text", noise().alias("__ll_noise")).mapInArrow(run, "doc_id long, log_weight double, sort_key double")


def _ordered(x: float) -> int:
    """A double as an integer of the same order."""
    (i,) = struct.unpack(">q", struct.pack(">d", x))
    return i if i >= 0 else i ^ 0x7FFFFFFFFFFFFFFF


def _double(i: int) -> float:
    return struct.unpack(">d", struct.pack(">q", i if i >= 0 else i ^ 0x7FFFFFFFFFFFFFFF))[0]


def kth_largest(values: DataFrame, k: int) -> tuple[int, int]:
    """The k-th largest of a table with one long column ``v``, and how many of its equals are within the k.

    Radix selection: four counting passes over 16 bits each, so the driver sees 65,536 counts at most, whatever the rows.
    """
    high, left = None, k
    for shift in (48, 32, 16, 0):
        part = values if high is None else values.filter(F.shiftright("v", shift + 16) == high)
        counts = sorted(((r[0], r[1]) for r in part.groupBy(F.shiftright("v", shift).alias("b")).count().collect()), reverse=True)
        for b, n in counts:
            if n >= left:
                high = b
                break
            left -= n
    return high, left


def threshold(scored: DataFrame, k: int) -> tuple[float, int | None, int]:
    """(key, doc_id, rows): the k rows of largest key are those above ``key`` and, of its equals, those up to ``doc_id`` (None: all)."""
    as_long = scored.mapInArrow(_to_long, "v long")
    v, left = kth_largest(materialise(as_long, "keys"), k)
    key = _double(v)
    equal = scored.filter(F.col("sort_key") == key)
    if equal.count() <= left:
        return key, None, k
    ids = materialise(equal.filter(F.col("doc_id").isNotNull()).select((F.lit(-1) - F.col("doc_id")).alias("v")), "ties")
    known = ids.count()
    if left > known:  # the nulls come last; they are equal, so they stay together
        return key, None, k
    last, _ = kth_largest(ids, left)
    return key, -1 - last, k


def _to_long(batches):
    for b in batches:
        i = b.column(b.schema.get_field_index("sort_key")).to_numpy(zero_copy_only=False).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(i >= 0, i, i ^ 0x7FFFFFFFFFFFFFFF))], ["v"])


def best_cut(weights: np.ndarray, good: np.ndarray) -> float | None:
    """The log weight that tells good from bad with the fewest errors, halfway between neighbours; of several the lowest. None without both."""
    if good.all() or not good.any():
        return None
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(int)
    errors = np.concatenate(([0], np.cumsum(g))) + np.concatenate(([0], np.cumsum(1 - g)))[-1] - np.concatenate(([0], np.cumsum(1 - g)))
    possible = np.concatenate(([True], w[1:] != w[:-1], [True]))
    i = int(np.argmin(np.where(possible, errors, len(w) + 1)))
    return float(w[0] - 1 if i == 0 else w[-1] + 1 if i == len(w) else (w[i - 1] + w[i]) / 2)


def sample_size(scored: DataFrame, known: dict[int, int]) -> int:
    """How many documents reach the weight that best tells the labelled good from the labelled bad; all if there aren't both."""
    spark = scored.sparkSession
    if not known:
        return scored.count()
    fitted = set(target_ids(known))
    ids = spark.createDataFrame([x for x in known.items() if x[0] not in fitted], "doc_id long, quality int")
    rows = scored.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("log_weight"), F.min("quality")).collect()
    cut = best_cut(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]) == 1) if rows else None
    return scored.count() if cut is None else scored.filter(F.col("log_weight") >= cut).count()


def _chosen(docs: DataFrame, labels: DataFrame, k: int | None):
    """(scored rows, ratio, threshold or None for none, whether any row is chosen)."""
    known = labelled(labels)
    ratio = fit(docs, known)
    scored = materialise(score(docs, ratio), "quality")
    n = scored.count()
    k = sample_size(scored, known) if k is None else k
    return scored, ratio, (threshold(scored, k) if 0 < k < n else None), k > 0


def _within(cut: tuple[float, int | None, int] | None, some: bool):
    if not some:
        return F.lit(False)
    if cut is None:
        return F.lit(True)
    key, last, _ = cut
    equal = F.col("sort_key") == key
    return (F.col("sort_key") > key) | (equal if last is None else equal & F.coalesce(F.col("doc_id") <= last, F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The chosen documents: doc_id, log_weight, sort_key. k defaults to ``sample_size``."""
    scored, _, cut, some = _chosen(docs, labels, k)
    return scored.filter(_within(cut, some))


def filter_quality(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The chosen documents with all their columns. Texts are scored again in place, which costs less than a shuffle of them."""
    _, ratio, cut, some = _chosen(docs, labels, k)
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    at = len(docs.columns)
    text, key = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches):
        for b in batches:
            if cut is None:
                keep = np.full(b.num_rows, some)
            else:
                v = _key(weigh(b.column(text), model.value), b.column(at).to_numpy(zero_copy_only=False))
                ids = b.column(key)
                before = ids.is_valid().to_numpy(zero_copy_only=False) & (ids.fill_null(0).to_numpy(zero_copy_only=False) <= (cut[1] or 0))
                keep = (v > cut[0]) | ((v == cut[0]) & (before if cut[1] is not None else True))
            yield pa.RecordBatch.from_arrays(b.columns[:at], schema=pa.schema(list(b.schema)[:at])).filter(pa.array(keep))

    return docs.select("*", noise().alias("__ll_noise")).mapInArrow(run, docs.schema)
