"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents (by doc_id). A window of ``window`` tokens visits the queues in turn; a queue's
quantum is its share of the window, a fraction that adds to its deficit, and it serves the whole tokens that its deficit
covers. What is left, less than a token, carries over to the next window. A queue that runs dry leaves its share to the
others. A document that doesn't fit its queue's service goes on in the next window.

Integer weights make the deficit after any number of windows a closed formula of the sources' totals, so every partition
of documents starts with exactly the deficits with which the one before it ended, and no window depends on a sequential
pass: documents need their place in their queue only, which is a two-level prefix sum (within range partitions, then over
the partitions' totals). One shuffle of (source, doc_id, token count) rows, none of texts.

Tokens are runs of non-blank characters. ``weights`` maps sources to positive integers; by default a source weighs as
the square root of its tokens. Every token is packed once; all windows but the last are full.

Results for odd input: null, empty or blank text has no tokens and no segment; a null source is a queue of its own, first
in order, and a null doc_id comes first in its queue; repeated rows are packed once each; an empty table gives no windows;
extra columns are ignored. A queue's share of a window must be at least a token: of more sources than a quarter of the
window's tokens the smallest share one queue, one source after the other; given ``weights`` that lack a source, aren't
positive integers or come to less raise ValueError.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise

WINDOW = 32_768
SCALE = 10**6
TOKEN = r"[^ \t\n\r\f\x0B]+"


def default_weights(totals: list[int], window: int) -> list[int]:
    roots = [math.isqrt(t) for t in totals]
    least = 2 * -(-SCALE // window)
    return [max(least, SCALE * r // max(1, sum(roots))) for r in roots]


def shared_queues(totals: list[int], most: int) -> list[tuple[int, int]]:
    """The queue of each source and how many tokens of other sources come before it there: one each, or the last for all that are too many."""
    own = set(sorted(range(len(totals)), key=lambda i: (-totals[i], i))[: most if len(totals) <= most else most - 1])
    out, n, before = [], 0, 0
    for i, t in enumerate(totals):
        out.append((n, 0) if i in own else (len(own), before))
        n += i in own
        before += 0 if i in own else t
    return out


class Schedule:
    """How many tokens of each queue the first t tokens of all windows hold."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        s = len(totals)
        if s and min(weights) * window < sum(weights):
            raise ValueError("a source's share of a window must be at least a token")
        self.window, self.total = window, sum(totals)
        self.windows = -(-self.total // window)
        # source i is dry at t if t w_i >= sum of min(w_j T_i, T_j w_i)
        dry = [-(-sum(min(wj * totals[i], tj * weights[i]) for tj, wj in zip(totals, weights)) // weights[i]) for i in range(s)]
        order = sorted(range(s), key=lambda i: dry[i])
        self.dry = np.array([dry[i] for i in order], np.int64)
        rank = np.empty(s, np.int64)
        rank[order] = np.arange(s)
        gone = rank[None, :] < np.arange(s + 1)[:, None]
        t, w = np.array(totals, np.int64), np.array(weights, np.int64)
        zero = np.zeros((s + 1, 1), np.int64)
        self.served = np.concatenate((zero, np.cumsum(np.where(gone, t, 0), 1)), 1)
        self.weight = np.concatenate((zero, np.cumsum(np.where(gone, 0, w), 1)), 1)

    def upto(self, t: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Tokens of the queues before ``source`` among the first t: ``upto(t, s + 1) - upto(t, s)`` is what queue s served."""
        phase = np.searchsorted(self.dry, t, "right")
        all_ = np.maximum(1, self.weight[phase, -1])
        rest = t - self.served[phase, -1]
        w = self.weight[phase, source]
        return self.served[phase, source] + rest // all_ * w + rest % all_ * w // all_

    def share(self, k: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Tokens that queue ``source`` has served when k windows are full."""
        t = np.minimum(k * self.window, self.total)
        return self.upto(t, source + 1) - self.upto(t, source)

    def first_window(self, place: np.ndarray, source: np.ndarray) -> np.ndarray:
        """The window that holds token ``place`` of the queue."""
        lo, hi = np.zeros(len(place), np.int64), np.full(len(place), self.windows, np.int64)
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            below = self.share(mid, source) <= place
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return lo


def _running(batches):
    """Adds each document's place among its source's tokens in this partition; rows come sorted by source."""
    carry: dict = {}
    for b in batches:
        n = b.column(2).to_numpy(zero_copy_only=False)
        code = b.column(1).dictionary_encode()
        group = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        names, off = code.dictionary.to_pylist(), np.zeros(len(n), np.int64)
        for g in np.unique(group):
            at, name = group == g, None if g < 0 else names[g]
            own = np.cumsum(n[at])
            off[at] = own - n[at] + carry.get(name, 0)
            carry[name] = carry.get(name, 0) + int(own[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(off)], ["doc_id", "source", "n", "part", "off"])


SEGMENTS = pa.schema([("window_id", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("n_tokens", pa.int64())])


def _cutter(plan, names):
    def run(batches):
        s, index = plan.value, names.value
        for b in batches:
            if not b.num_rows:
                continue
            source, before_it = np.array([index[x] for x in b.column(1).to_pylist()], np.int64).T
            n, c = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False) + before_it
            lo, hi = s.first_window(c, source), s.first_window(c + n - 1, source)
            doc = np.repeat(np.arange(len(n)), hi - lo + 1)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[doc]
            src = source[doc]
            before = s.share(k, src)
            start, end = np.maximum(c[doc], before), np.minimum(c[doc] + n[doc], s.share(k + 1, src))
            pos = s.upto(np.minimum((k + 1) * s.window, s.total), src) - s.upto(k * s.window, src) + start - before
            ok = np.flatnonzero(end > start)
            yield pa.RecordBatch.from_arrays([pa.array(k[ok]), pa.array(pos[ok]), b.column(0).take(pa.array(doc[ok])), b.column(1).take(pa.array(doc[ok])), *(pa.array(x[ok]) for x in (start - c[doc], end - c[doc], end - start))], schema=SEGMENTS)

    return run


def pack(docs: DataFrame, window: int = WINDOW, weights: dict | None = None) -> DataFrame:
    """The windows' segments: window_id, pos (first token in the window), doc_id, source, start_token and end_token in the document, n_tokens."""
    units = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count("text", F.lit(TOKEN)).cast("long").alias("n")).filter("n > 0")
    units = materialise(units, "lengths")  # the range partitioner samples its input, which then is not the texts
    ranged = units.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id", "n")
    placed = materialise(ranged.select("*", F.spark_partition_id().alias("part")).mapInArrow(_running, "doc_id long, source string, n long, part int, off long"), "queues")
    parts = placed.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    base = parts.withColumn("base", F.sum("tokens").over(W.partitionBy("source").orderBy("part")) - F.col("tokens")).select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    totals = sorted(((r[0], r[1]) for r in parts.groupBy("source").agg(F.sum("tokens")).collect()), key=lambda x: (x[0] is not None, (x[0] or "").encode()))
    queues = shared_queues([x[1] for x in totals], max(1, window // 4)) if weights is None else [(i, 0) for i in range(len(totals))]
    counts = [0] * (1 + max((q for q, _ in queues), default=-1))
    for (q, _), (_, n) in zip(queues, totals):
        counts[q] += n
    if weights is not None:
        odd = [x for x, _ in totals if not isinstance(weights.get(x), int) or weights[x] <= 0]
        if odd:
            raise ValueError(f"the weights of {odd} must be positive integers")
    w = default_weights(counts, window) if weights is None else [weights[x] for x, _ in totals]
    names = {x: q for (x, _), q in zip(totals, queues)}
    send = docs.sparkSession.sparkContext.broadcast
    rows = placed.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("doc_id", "source", "n", (F.col("base") + F.col("off")).alias("c"))
    return rows.mapInArrow(_cutter(send(Schedule(counts, w, window)), send(names)), "window_id long, pos long, doc_id long, source string, start_token long, end_token long, n_tokens long")


SQL = rf"""
WITH u AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n FROM documents WHERE len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) > 0),
q AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING)::HUGEINT - n AS c FROM u),
t AS (SELECT source, sum(n)::HUGEINT AS total, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM u GROUP BY source),
w AS (SELECT *, greatest({2 * -(-SCALE // WINDOW)}, ({SCALE} * floor(sqrt(total))::HUGEINT) // (SELECT sum(floor(sqrt(total))::HUGEINT) FROM t))::HUGEINT AS weight FROM t),
g AS (SELECT a.i, a.source, a.total, a.weight, sum(least(b.weight * a.total, b.total * a.weight))::HUGEINT AS dry FROM w a, w b GROUP BY ALL),
k AS (SELECT unnest(range((SELECT (sum(total)::BIGINT + {WINDOW - 1}) // {WINDOW} + 1 FROM t))) AS k),
b AS (SELECT k, least(k * {WINDOW}, (SELECT sum(total)::HUGEINT FROM t)) AS t FROM k),
x AS (SELECT k, t, i, source, CASE WHEN t * weight >= dry THEN total ELSE 0 END AS done, CASE WHEN t * weight >= dry THEN 0 ELSE weight END AS active FROM b, g),
y AS (SELECT *, sum(done) OVER (PARTITION BY k ORDER BY i)::HUGEINT AS done_to, sum(active) OVER (PARTITION BY k ORDER BY i)::HUGEINT AS active_to, sum(done) OVER (PARTITION BY k)::HUGEINT AS done_all, sum(active) OVER (PARTITION BY k)::HUGEINT AS active_all FROM x),
z AS (SELECT k, i, source, done_to + ((t - done_all) * active_to) // greatest(1, active_all) AS upto FROM y),
a AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY k ORDER BY i), 0) AS below FROM z),
s AS (SELECT k, source, upto - below AS lo, below AS base, lead(upto - below) OVER (PARTITION BY source ORDER BY k) AS hi, lead(below) OVER (PARTITION BY source ORDER BY k) AS next_base FROM a)
SELECT s.k::BIGINT AS window_id, (next_base - base + greatest(c, lo) - lo)::BIGINT AS pos, doc_id, q.source, (greatest(c, lo) - c)::BIGINT AS start_token, (least(c + n, hi) - c)::BIGINT AS end_token, (least(c + n, hi) - greatest(c, lo))::BIGINT AS n_tokens
FROM q JOIN s ON q.source IS NOT DISTINCT FROM s.source AND c < hi AND c + n > lo AND hi > lo
"""
