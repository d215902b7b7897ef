"""Filters, rankings and fusion of searches over spans. Queries come as tables: many of them are one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.ids import unsigned_order
from spanloom.functions.vectors import distance

KEY = ["trace_id", "span_id"]
K1, B, RRF = 1.5, 0.75, 60
TEXT = ["input_text", "output_text", "agent_name", "tool_name", "model"]
DIGITS = 6


@dataclass(frozen=True)
class SearchFilter:
    """Conditions on hits. Times are ns; a span matches if its events' range meets the interval."""

    trace_id: int | None = None
    tenant_id: int | None = None
    agent_name: str | None = None
    status: int | None = None
    time_from: int | None = None
    time_to: int | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        for c in ("trace_id", "tenant_id", "agent_name", "status"):
            if getattr(self, c) is not None:
                out = out & (F.col(c) == getattr(self, c))
        if self.time_from is not None:
            out = out & (F.col("max_ts") >= self.time_from)
        if self.time_to is not None:
            out = out & (F.col("min_ts") <= self.time_to)
        return out

    def asks_attributes(self) -> bool:
        return any(getattr(self, c) is not None for c in ("tenant_id", "agent_name", "status", "time_from", "time_to"))


def restrict(df: DataFrame, attrs: DataFrame | None, wanted: SearchFilter | Column | str | None) -> DataFrame:
    """The rows whose span meets a filter: a SearchFilter, a condition or SQL text over the attributes."""
    if wanted is None:
        return df
    if isinstance(wanted, SearchFilter):
        if not wanted.asks_attributes():
            return df.filter(wanted.condition())
        wanted = wanted.condition()
    keys = attrs.filter(F.expr(wanted) if isinstance(wanted, str) else wanted).select(*KEY)
    return df.join(keys, KEY, "left_semi")


def search_text(events: DataFrame) -> DataFrame:
    """trace_id, span_id, text: what search sees of deduplicated events; a span's text is that of all its events."""
    have = [c for c in TEXT if c in events.columns]
    logs = F.array_join("logs", " ") if "logs" in events.columns else F.lit(None)
    return events.select(*KEY, F.concat_ws(" ", *have, logs).alias("text"))


def top(df: DataFrame, k: int | None, by: Column) -> DataFrame:
    """Rank of each query's rows, ties by key; the first ``k`` of them (None: all)."""
    w = W.partitionBy("query_id").orderBy(by, unsigned_order(F.col("trace_id")), unsigned_order(F.col("span_id")))
    out = df.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def contains_search(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The number of the query's words that a text contains, without an index."""
    score = sum((F.col("text").contains(w).cast("int") for w in query.split()), F.lit(0))
    out = docs.withColumns({"score": score.cast("double"), "query_id": F.lit(0)}).filter("score > 0").select("query_id", *KEY, "score")
    return top(out, k, F.desc("score"))


def latest_embeddings(embeddings: DataFrame) -> DataFrame:
    """The last vector written for each span."""
    return embeddings.groupBy(*KEY).agg(F.max_by("embedding", "lsn").alias("embedding"))


def vector_scan(embeddings: DataFrame, query: list[float], k: int = 10, metric: str = "l2") -> DataFrame:
    """The exact nearest ``k`` to one vector, by column functions."""
    d = F.round(distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)), metric), DIGITS)
    out = embeddings.filter(F.size("embedding") == len(query)).select(F.lit(0).alias("query_id"), *KEY, d.alias("distance"))
    best = out.orderBy("distance", unsigned_order(F.col("trace_id")), unsigned_order(F.col("span_id"))).limit(k)
    return top(best, k, F.asc("distance"))


def rrf(rankings: list[DataFrame], k: int | None = 10, c: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query_id, trace_id, span_id, rank)."""
    both = rankings[0].select("query_id", *KEY, "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("query_id", *KEY, "rank"))
    fused = both.groupBy("query_id", *KEY).agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    return top(fused, k, F.desc("score"))


def over_pool(k: int) -> int:
    """How many hits of each search are fused or filtered for ``k`` results."""
    return max(k, 10)


def join_spans(ranked: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits with their folded spans, in rank order; hits that the snapshot doesn't show vanish."""
    return ranked.join(spans, KEY).orderBy("query_id", "rank")
