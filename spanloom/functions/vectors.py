"""Distances over ARRAY<FLOAT> columns, and the same in numpy for batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "ip")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def l2_squared(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2; cosine: l2 of the normalised vectors; ip: the negative inner product."""
    if metric == "ip":
        return -dot(a, b)
    if metric == "cosine":
        a, b = normalize(a), normalize(b)
    return F.sqrt(l2_squared(a, b))


def batch_distance(rows: np.ndarray, queries: np.ndarray, metric: str = "l2") -> np.ndarray:
    """(rows, queries) in double: one matrix product."""
    rows, queries = rows.astype(float), queries.astype(float)
    if metric == "ip":
        return -(rows @ queries.T)
    if metric == "cosine":
        rows, queries = (x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1) for x in (rows, queries))
    squares = (rows**2).sum(1)[:, None] + (queries**2).sum(1)[None] - 2 * (rows @ queries.T)
    return np.sqrt(np.maximum(squares, 0))
