"""Trace trees and agent call graphs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import render, unsigned_order
from spanloom.sources.files import written

#: Hops after which a parent chain counts as a cycle.
MAX_DEPTH = 65
#: Spans of a trace that one task holds; larger traces go by joins. Rows that a task works on together.
IN_TASK, TOGETHER = 1_000_000, 200_000
NODE = ["trace_id", "span_id", "parent_span_id"]


def trace_tree(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_span_id, is_root, children (by id). A span whose parent isn't in the trace is a root; one that is its own parent is its own child and no root."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_known"))
    kids = spans.filter(F.col("parent_span_id").isNotNull()).groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct(unsigned_order(F.col("span_id")).alias("o"), F.col("span_id").alias("id")))), lambda x: x["id"]).alias("children"))
    nodes = spans.select("trace_id", "span_id", "parent_span_id").join(known, ["trace_id", "parent_span_id"], "left")
    return nodes.join(kids, ["trace_id", "span_id"], "left").select("trace_id", "span_id", "parent_span_id", F.col("_known").isNull().alias("is_root"), F.coalesce("children", F.array().cast("array<bigint>")).alias("children"))


def _index(trace: np.ndarray, span: np.ndarray, parent: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of trace and span, each trace's number, and the row of each row's parent (-1: none there)."""
    order = np.lexsort((span, trace))
    trace, span, parent, has = trace[order], span[order], parent[order], has[order]
    group = np.cumsum(np.concatenate(([0], trace[1:] != trace[:-1]))) if len(trace) else np.zeros(0, np.int64)
    codes = np.unique(span)
    key = group * len(codes) + np.searchsorted(codes, span)
    code = np.minimum(np.searchsorted(codes, parent), len(codes) - 1)
    wanted = group * len(codes) + code
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return order, group, np.where(has & (codes[code] == parent) & (key[at] == wanted), at, -1)


def _hops(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ancestors of each row, and whether the chain ends; pointer doubling."""
    depth, far = (up >= 0).astype(np.int64), up.copy()
    for _ in range(max(1, len(up)).bit_length() + 1):
        on = far >= 0
        if not on.any():
            break
        depth[on] += depth[far[on]]
        far[on] = far[far[on]]
    return depth, far < 0


def depths(trace: np.ndarray, span: np.ndarray, parent: np.ndarray, has: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and depth of the rows of whole traces."""
    order, _, up = _index(trace, span, parent, has)
    depth, ends = _hops(up)
    # The hop from the last known ancestor to a parent that isn't there.
    root, far = np.arange(len(up)), up.copy()
    for _ in range(max(1, len(up)).bit_length() + 1):
        on = far >= 0
        if not on.any():
            break
        root[on] = root[far[on]]
        far[on] = far[far[on]]
    return order, np.where(ends, np.minimum(depth + has[order][root], most), most)


def preorder(trace: np.ndarray, span: np.ndarray, parent: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of whole traces that a root reaches, and their places in preorder from 0: the ranks of an Euler tour."""
    order, group, up = _index(trace, span, parent, has)
    keep = np.flatnonzero(_hops(up)[1])
    place = np.full(len(up), -1)
    place[keep] = np.arange(len(keep))
    order, group, up = order[keep], group[keep], np.where(up[keep] >= 0, place[up[keep]], -1)
    n = len(keep)
    follow = np.concatenate((np.arange(n) + n, np.where(up >= 0, up + n, -1)))
    kids = np.lexsort((np.arange(n), up, group))
    if n:
        same = (up[kids][1:] == up[kids][:-1]) & (group[kids][1:] == group[kids][:-1])
        follow[kids[:-1][same] + n] = kids[1:][same]
        first = kids[np.concatenate(([True], ~same))]
        follow[up[first[up[first] >= 0]]] = first[up[first] >= 0]
    left = np.concatenate((np.ones(n, np.int64), np.zeros(n, np.int64)))
    while (on := follow >= 0).any():
        left[on] += left[follow[on]]
        follow[on] = follow[follow[on]]
    return order, np.bincount(group, minlength=1)[group] - left[:n] if n else left[:0]


def _whole_traces(work: Callable):
    """Arrow batches sorted by trace, as arrays of whole traces of about ``TOGETHER`` rows."""

    def arrays(parts):
        t = pa.Table.from_batches(parts)
        trace, span = (t.column(c).to_numpy().view(np.uint64) for c in ("trace_id", "span_id"))
        parent = t.column("parent_span_id").combine_chunks()
        return trace, span, pc.fill_null(parent, 0).to_numpy(zero_copy_only=False).view(np.uint64), pc.is_valid(parent).to_numpy(zero_copy_only=False)

    def run(batches):
        parts, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            parts.append(b)
            size += b.num_rows
            if size < TOGETHER:
                continue
            trace = b.column(0).to_numpy()
            cut = int(np.argmax(trace == trace[-1]))
            if cut:
                yield work(*arrays([*parts[:-1], b.slice(0, cut)]))
                parts, size = [b.slice(cut)], b.num_rows - cut
        if parts:
            yield work(*arrays(parts))

    return run


def _depth_rows(most: int):
    def work(trace, span, parent, has):
        order, depth = depths(trace, span, parent, has, most)
        return pa.RecordBatch.from_arrays([pa.array(trace[order].view(np.int64)), pa.array(span[order].view(np.int64)), pa.array(depth.astype(np.int32))], ["trace_id", "span_id", "depth"])

    return work


def _visit_rows(trace, span, parent, has):
    order, visit = preorder(trace, span, parent, has)
    return pa.RecordBatch.from_arrays([pa.array(trace[order].view(np.int64)), pa.array(span[order].view(np.int64)), pa.array(visit)], ["trace_id", "span_id", "visit"])


def _by_size(spans: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The tree columns of the traces of up to ``most`` spans, and of the larger ones if there are any. The spans are computed once."""
    nodes = written(spans.select(*NODE), "nodes")
    large = nodes.groupBy("trace_id").count().filter(F.col("count") > most).select("trace_id")
    large = written(large, "large")
    if large.isEmpty():
        return nodes, None
    return nodes.join(large, "trace_id", "left_anti"), written(nodes.join(large, "trace_id", "left_semi"), "large-nodes")


def _small(nodes: DataFrame, work: Callable, schema: str) -> DataFrame:
    return nodes.repartition("trace_id").sortWithinPartitions("trace_id").mapInArrow(_whole_traces(work), schema)


def trace_depth(spans: DataFrame, most: int = MAX_DEPTH, in_task: int = IN_TASK) -> DataFrame:
    """Parent hops of each span; the hop to a missing parent counts; chains that don't end stop at ``most``.

    Traces of up to ``in_task`` spans are climbed whole in one task after one shuffle. In larger ones each span is joined
    with its ancestor at twice the distance, round by round, so a trace may be as large as the table.
    """
    small, large = _by_size(spans, in_task)
    out = _small(small, _depth_rows(most), "trace_id bigint, span_id bigint, depth int")
    if large is None:
        return out
    n = large.select("trace_id", "span_id", F.col("parent_span_id").alias("up")).withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1))
    hops = 1
    while hops < most:
        other = n.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.lit(1).alias("known"))
        n = written(n.join(other, ["trace_id", "up"], "left").select("trace_id", "span_id", F.when(F.col("known").isNotNull(), F.col("next")).alias("up"), F.least(F.col("depth") + F.coalesce("more", F.lit(0)), F.lit(most)).alias("depth")), "depth")
        hops *= 2
    return out.union(n.select("trace_id", "span_id", F.col("depth").cast("int")))


def _reached(nodes: DataFrame) -> DataFrame:
    """The nodes that a root reaches, with ``up`` null where the parent isn't in the trace; parents are joined at doubling distance."""
    known = nodes.select("trace_id", F.col("span_id").alias("up"), F.lit(1).alias("_k"))
    n = nodes.select("trace_id", "span_id", F.col("parent_span_id").alias("up")).join(known, ["trace_id", "up"], "left")
    n = written(n.select("trace_id", "span_id", F.when(F.col("_k").isNotNull(), F.col("up")).alias("up")), "parents")
    far, hops, largest = n.withColumnRenamed("up", "far"), 1, nodes.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    while hops <= largest and not far.filter("far is not null").isEmpty():
        other = far.select("trace_id", F.col("span_id").alias("far"), F.col("far").alias("next"))
        far = written(far.join(other, ["trace_id", "far"], "left").select("trace_id", "span_id", F.col("next").alias("far")), "ancestors")
        hops *= 2
    return written(n.join(far.filter("far is null").select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi"), "reached")


def _numbered(batches):
    n = 0
    for b in batches:
        yield b.append_column("pos", pa.array(np.arange(n, n + b.num_rows)))
        n += b.num_rows


def _with_next(n: DataFrame) -> DataFrame:
    """Each node with its next sibling, and whether it is a first child: neighbours in one global order, which no trace or parent has to itself."""
    ranged = n.select("trace_id", "up", unsigned_order(F.col("span_id")).alias("o")).repartitionByRange("trace_id", "up", "o").sortWithinPartitions("trace_id", "up", "o")
    placed = written(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_numbered, "trace_id bigint, up bigint, o bigint, part int, pos bigint"), "siblings")
    base, sizes = 0, []
    for part, size in placed.groupBy("part").count().orderBy("part").collect():
        sizes += [F.lit(part), F.lit(base).cast("bigint")]
        base += size
    if not sizes:
        return n.select("*", F.lit(None).cast("bigint").alias("sibling"), F.lit(True).alias("leads"))
    line = written(placed.select("trace_id", "up", "o", (F.create_map(*sizes)[F.col("part")] + F.col("pos")).alias("at")), "line")
    before = line.select((F.col("at") + 1).alias("at"), F.struct("trace_id", "up").alias("b"))
    after = line.select((F.col("at") - 1).alias("at"), F.struct("trace_id", "up").alias("a"), F.col("o").alias("ao"))
    own = F.struct("trace_id", "up")
    both = line.join(before, "at", "left").join(after, "at", "left")
    return both.select("trace_id", unsigned_order(F.col("o")).alias("span_id"), "up", F.when(own == F.col("a"), unsigned_order(F.col("ao"))).alias("sibling"), (F.col("b").isNull() | (own != F.col("b"))).alias("leads"))


def _tour(nodes: DataFrame) -> DataFrame:
    """Preorder of traces of any size: a span is entered and left; each of these steps points to the next; ranks by pointer doubling."""
    n = written(_with_next(_reached(nodes)), "tree")
    first = n.filter("leads and up is not null").select("trace_id", F.col("up").alias("span_id"), F.col("span_id").alias("first"))
    step = lambda kind, span: F.struct(F.lit(kind).alias("out"), F.col(span).alias("span"))
    enter = n.join(first, ["trace_id", "span_id"], "left").select("trace_id", step(0, "span_id").alias("at"), F.when(F.col("first").isNotNull(), step(0, "first")).otherwise(step(1, "span_id")).alias("to"), F.lit(1).cast("bigint").alias("left"))
    leave = n.select("trace_id", step(1, "span_id").alias("at"), F.when(F.col("sibling").isNotNull(), step(0, "sibling")).when(F.col("up").isNotNull(), step(1, "up")).alias("to"), F.lit(0).cast("bigint").alias("left"))
    tour = written(enter.union(leave), "tour")
    while not tour.filter("to is not null").isEmpty():
        other = tour.select("trace_id", F.col("at").alias("to"), F.col("to").alias("next"), F.col("left").alias("more"))
        tour = written(tour.join(other, ["trace_id", "to"], "left").select("trace_id", "at", F.col("next").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour")
    total = n.groupBy("trace_id").agg(F.count("*").alias("n"))
    return tour.filter("at.out = 0").join(total, "trace_id").select("trace_id", F.col("at.span").alias("span_id"), (F.col("n") - F.col("left")).alias("visit"))


def trace_dfs(spans: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Preorder of each trace's forest, children by id: trace_id, span_id, visit (from 0). Chains may be of any length.

    Spans on or below a cycle are not reached from a root and are left out. Traces of up to ``in_task`` spans are toured
    whole in one task after one shuffle, larger ones by joins, so a trace may be as large as the table.
    """
    small, large = _by_size(spans, in_task)
    out = _small(small, _visit_rows, "trace_id bigint, span_id bigint, visit bigint")
    return out if large is None else out.union(_tour(large))


def _actors(spans: DataFrame) -> DataFrame:
    return spans.withColumn("actor", F.coalesce("agent_name", "tool_name", F.concat(F.lit("span:"), render(F.col("span_id")))))


def agent_graph_nodes(spans: DataFrame) -> DataFrame:
    """Actors of each trace: agent, else tool, else the span itself; kind of the first span; spans and tokens."""
    kind = F.when(F.col("agent_name").isNotNull(), "agent").when(F.col("tool_name").isNotNull(), "tool").otherwise("span")
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return _actors(spans).withColumn("kind", kind).groupBy("trace_id", "actor").agg(F.min_by("kind", unsigned_order(F.col("span_id"))).alias("kind"), F.count("*").alias("span_count"), F.sum(tokens).cast("bigint").alias("total_tokens"))


def agent_graph_edges(spans: DataFrame) -> DataFrame:
    """Calls from a parent's actor to another actor."""
    a = _actors(spans)
    callers = a.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("actor").alias("caller"))
    return a.select("trace_id", "parent_span_id", F.col("actor").alias("callee")).join(callers, ["trace_id", "parent_span_id"]).filter("caller <> callee").groupBy("trace_id", "caller", "callee").agg(F.count("*").alias("calls"))
