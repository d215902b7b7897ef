"""Nearest vectors for tables of queries: exact, or among the nearest lists of an inverted file.

Queries and vectors are packed into blocks of up to ``BLOCK`` of one length. Each pair of blocks is a few matrix products; a task
keeps the best of every query over all the blocks it sees and passes ``k`` rows a query on. What is further than the best that a
query has already isn't looked at again.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.vectors import batch_distance
from spanloom.operators.search import DIGITS, KEY, top
from spanloom.sources.files import Files, written

BLOCK = 2048
#: Candidates that a task holds before it passes them on.
HELD = 500_000
#: Queries of one product, and least distances that a task remembers of the queries it has seen.
ROWS, KNOWN = 512, 8_000_000
#: Blocks of queries up to this size go to every executor; larger ones meet the vectors without a broadcast.
SENT_BYTES = 64 << 20
_BLOCKS = "list int, dim int, n int, a binary, b binary, data binary"


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of vectors; null vectors have length 0, null values are 0."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(column.flatten().cast(pa.float32()), 0).to_numpy(zero_copy_only=False)


def _groups(lists: np.ndarray, lengths: np.ndarray, flat: np.ndarray):
    """(list, rows, matrix) of up to BLOCK vectors of one list and length."""
    first = np.cumsum(lengths) - lengths
    order = np.lexsort((np.arange(len(lists)), lengths, lists))
    order = order[lengths[order] > 0]
    cut = np.flatnonzero((np.diff(lists[order]) != 0) | (np.diff(lengths[order]) != 0)) + 1
    for part in np.split(order, cut):
        for k in range(0, len(part), BLOCK):
            rows = part[k : k + BLOCK]
            yield int(lists[rows[0]]), rows, flat[first[rows][:, None] + np.arange(lengths[rows[0]])]


def _pack(batches):
    for b in batches:
        if not b.num_rows:
            continue
        lists, a, c = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        rows = [(at, x.shape[1], len(own), a[own].tobytes(), c[own].tobytes(), x.tobytes()) for at, own, x in _groups(lists, *_flat(b.column(3)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["list", "dim", "n", "a", "b", "data"])


def blocks(df: DataFrame, a: str, b: str, vector: str, at: str | None = None) -> DataFrame:
    """Vectors with two numbers each, in blocks of one list."""
    zero = F.lit(0)
    columns = [(zero if at is None else F.col(at)).cast("int"), F.col(a).cast("bigint"), (F.col(b) if b else zero).cast("bigint"), F.col(vector)]
    return df.select(*(c.alias(n) for c, n in zip(columns, ("list", "a", "b", "v")))).mapInArrow(_pack, _BLOCKS)


def _scan(k: int, metric: str):
    def best(parts):
        """Of each query the first k by distance and key."""
        q, d, trace, span = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((span, trace, d, q))
        q = q[order]
        begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        keep = order[rank < k]
        return tuple(x[keep] for x in (np.concatenate([p[0] for p in parts]), d, trace, span))

    def rows(held):
        if held:
            q, d, trace, span = best(held)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(trace.view(np.int64)), pa.array(span.view(np.int64)), pa.array(d)], ["query_id", "trace_id", "span_id", "distance"])

    def run(batches):
        held, size, known = [], 0, {}
        for dim, ids, asked, a, c, data in _one_by_one(batches):
            x, q = np.frombuffer(data, np.float32).reshape(-1, dim).astype(float), np.frombuffer(asked, np.float32).reshape(-1, dim).astype(float)
            if ids not in known:
                if len(known) * BLOCK * k > KNOWN:
                    known.clear()
                known[ids] = np.full((len(q), k), np.inf)
            for i in range(0, len(q), ROWS):
                row, column, d = _closer(q[i : i + ROWS], x, known[ids][i : i + ROWS], metric)
                held.append((np.frombuffer(ids, np.int64)[i + row], d, np.frombuffer(a, np.uint64)[column], np.frombuffer(c, np.uint64)[column]))
                size += len(row)
            if size > HELD:
                held = [best(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from rows(held)
                    held, size = [], 0
        yield from rows(held)

    return run


def _one_by_one(batches):
    """The rows of batches, one at a time: a batch's blocks are never all copied."""
    for b in batches:
        columns = [b.column(n) for n in ("dim", "q_a", "q_data", "a", "b", "data")]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _closer(q: np.ndarray, x: np.ndarray, known: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and rounded distance of what may be among the first of each query, whose ``known`` least distances are kept up.

    One product finds them, with room for its error and for rounding; their distances are then computed by themselves.
    """
    if metric == "cosine":
        q, x = (y / np.where((n := np.linalg.norm(y, axis=1, keepdims=True)) > 0, n, 1) for y in (q, x))
    k = known.shape[1]
    near = q @ x.T
    qq, xx = (q**2).sum(1)[:, None], (x**2).sum(1)
    if metric == "ip":
        np.negative(near, out=near)
    else:
        near *= -2
        near += qq
        near += xx
    most = known.max(1, keepdims=True)
    unit, error = 2 * 10.0**-DIGITS, 1e-12 * (qq + xx.max(initial=0))
    least = most + unit + error if metric == "ip" else (most + unit) ** 2 + error
    if np.isinf(most).any():
        kth = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1 :][:, :1]
        own = kth + unit + 2 * error if metric == "ip" else (np.sqrt(np.maximum(kth + error, 0)) + unit) ** 2 + error
        least = np.minimum(least, own)
    row, column = np.nonzero(near <= least)
    d = -(q[row] * x[column]).sum(1) if metric == "ip" else np.sqrt(((q[row] - x[column]) ** 2).sum(1))
    d = np.round(d, DIGITS)
    order = np.lexsort((d, row))
    own = row[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    some = rank < k
    fresh = np.full(known.shape, np.inf)
    fresh[own[some], rank[some]] = d[order][some]
    known[:] = np.partition(np.concatenate((known, fresh), axis=1), k - 1, axis=1)[:, :k]
    keep = d <= known.max(1)[row]
    return row[keep], column[keep], d[keep]


def _meet(vectors: DataFrame, queries: DataFrame, k: int, metric: str, by_list: bool) -> DataFrame:
    """Blocks of vectors with blocks of queries, of the same list if there are lists."""
    if not k:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, trace_id bigint, span_id bigint, distance double, rank int")
    asked = written(queries, "asked").select(F.col("list").alias("q_list"), F.col("dim").alias("q_dim"), F.col("a").alias("q_a"), F.col("data").alias("q_data"))
    size = asked.agg(F.sum(F.octet_length("q_data"))).first()[0] or 0
    small = F.broadcast(asked) if size <= SENT_BYTES else asked
    same = F.col("dim") == F.col("q_dim")
    pairs = vectors.join(small, same & (F.col("list") == F.col("q_list"))) if by_list else vectors.crossJoin(small).filter(same)
    found = pairs.select("dim", "q_a", "q_data", "a", "b", "data").mapInArrow(_scan(k, metric), "query_id bigint, trace_id bigint, span_id bigint, distance double")
    return top(found, k, F.asc("distance"))


def vector_batch(embeddings: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """The exact nearest ``k`` of each row of queries (query_id, vector): query_id, trace_id, span_id, distance, rank. Vectors of another length don't count."""
    return _meet(blocks(embeddings, *KEY, "embedding"), blocks(queries, "query_id", "", "vector"), k, metric, False)


class VectorIndex:
    """An inverted file: every vector in the list of its nearest centroid, a folder for each list.

    Centroids are found by k-means on the ``sample`` vectors of least hash; all vectors are indexed. A search reads the lists
    of the nearest ``probes`` centroids of its queries and no others.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(Files(spark, self.path).read("about.json"))
        self.centroids, self.metric = np.array(about["centroids"], np.float32), about["metric"]

    @classmethod
    def build(cls, embeddings: DataFrame, path: str, lists: int = 64, metric: str = "l2", seed: int = 1, sample: int = 20_000, steps: int = 10) -> VectorIndex:
        spark = embeddings.sparkSession
        rows = embeddings.filter(F.size("embedding") > 0).orderBy(F.xxhash64(*KEY, F.lit(seed)), *KEY).limit(sample).select("embedding").collect()
        width = max((len(r[0]) for r in rows), default=0)
        x = _unit(np.array([r[0] for r in rows if len(r[0]) == width], np.float32).reshape(-1, width), metric)
        centroids = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(steps):
            near = batch_distance(x, centroids).argmin(1) if len(x) else np.zeros(0, int)
            centroids = np.array([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centroids)], np.float32).reshape(-1, width)
        own = embeddings.filter(F.size("embedding") == width).select(*KEY, "embedding", _nearest(centroids, 1, metric)("embedding")[0].alias("list"))
        blocks(own, *KEY, "embedding", "list").write.partitionBy("list").parquet(f"{path}/lists")
        Files(spark, path).publish("about.json", json.dumps({"centroids": centroids.tolist(), "metric": metric}))
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 40) -> DataFrame:
        """The nearest ``k`` of each row of queries (query_id, vector) among its ``probes`` nearest lists."""
        asked = queries.filter(F.size("vector") == self.centroids.shape[1]).select("query_id", "vector", F.explode(_nearest(self.centroids, probes, self.metric)("vector")).alias("list"))
        return _meet(self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/lists"), blocks(asked, "query_id", "", "vector", "list"), k, self.metric, True)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the centroids see them: of length 1 unless only distance counts."""
    return x if metric == "l2" else x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _nearest(centroids: np.ndarray, n: int, metric: str):
    """The lists of the nearest centroids of each vector, as a column function."""

    @F.arrow_udf("array<int>")
    def near(vectors: pa.Array) -> pa.Array:
        _, flat = _flat(vectors)
        x = _unit(flat.reshape(len(vectors), -1), metric) if len(vectors) else np.zeros((0, centroids.shape[1]), np.float32)
        most = min(n, len(centroids))
        best = batch_distance(x, centroids).argsort(1, kind="stable")[:, :most].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * most), pa.array(best.ravel()))

    return near
