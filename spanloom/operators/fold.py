"""Events to spans: dedup, last-non-null fold, late patches, tombstones, windows and tenants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.ids import unsigned_order
from spanloom.sources.schema import FOLDED

KEY = ["trace_id", "span_id"]
EVENT = ["ext_span_id", "seq", "event_type"]


@dataclass(frozen=True)
class TraceQuery:
    """What a read covers. Times are ns, both ends included."""

    trace_id: int | None = None
    time_from: int | None = None
    time_to: int | None = None
    tenant_id: int | None = None

    def events(self, events: DataFrame) -> DataFrame:
        """The part that can be asked of events; it reaches the scan."""
        if self.trace_id is not None:
            events = events.filter(F.col("trace_id") == self.trace_id)
        if self.time_from is not None:
            events = events.filter(F.col("ts") >= self.time_from)
        if self.time_to is not None:
            events = events.filter(F.col("ts") <= self.time_to)
        return events


def place(events: DataFrame, order: list[str]) -> Column:
    """Scan order of an event as one comparable value."""
    return F.struct(*order) if len(order) > 1 else F.col(order[0])


def dedup(events: DataFrame, order: list[str], scope: str = "span") -> DataFrame:
    """The first event of each identity in scan order.

    ``scope='global'`` compares all events, with a shuffle of its own. ``'span'`` compares within (trace, span), which is
    the same where an external span id names one span, and shares the fold's shuffle.
    """
    if scope == "global":
        keys = EVENT
    else:
        events, keys = events.repartition(*KEY), KEY + EVENT
    w = W.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def fold(events: DataFrame, order: list[str], scope: str = "span") -> DataFrame:
    """Spans: of each value the last non-null by (seq, scan order), logs in order without repeats, number of events."""
    have = set(events.columns)
    at = F.struct(F.col("seq"), *(F.col(o) for o in order))
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in FOLDED.items()]
    logs = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.coalesce("logs", F.array().cast("array<string>")).alias("logs")))), lambda x: x["logs"])))
    return dedup(events, order, scope).groupBy(*KEY).agg(*[v for v in values], logs.alias("logs"), F.count("*").alias("event_count"))


def merge_patches(patches: DataFrame) -> DataFrame:
    """One patch for each span: of each value the last non-null by (segment, patch number), logs in that order."""
    at = F.struct("segment_id", "patch_seq")
    have = set(patches.columns)
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in FOLDED if c in have]
    out = patches.groupBy(*KEY)
    if "logs" not in have:
        return out.agg(*values)
    logs = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), F.coalesce("logs", F.array().cast("array<string>")).alias("logs")))), lambda x: x["logs"])))
    return out.agg(*values, logs.alias("logs"))


def apply_patches(spans: DataFrame, patches: DataFrame) -> DataFrame:
    """A patch's non-null values win; its new logs follow. Patches of absent spans do nothing."""
    merged = merge_patches(patches)
    renamed = merged.select(*KEY, *(F.col(c).alias(f"_p_{c}") for c in merged.columns if c not in KEY))
    out = spans.join(renamed, KEY, "left")
    columns = []
    for c in spans.columns:
        if f"_p_{c}" not in renamed.columns:
            columns.append(F.col(c))
        elif c == "logs":
            columns.append(F.when(F.col("_p_logs").isNull(), F.col("logs")).otherwise(F.array_union("logs", "_p_logs")).alias("logs"))
        else:
            columns.append(F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c))
    return out.select(*columns)


def merge_spans(left: DataFrame, right: DataFrame) -> DataFrame:
    """Span-wise merge of two sets of folded values: right's non-null values win, logs are joined."""
    return apply_patches(left, right.withColumns({"segment_id": F.lit(0), "patch_seq": F.lit(0)}))


def drop_tombstones(events: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return events.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def only_keys(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events of candidate spans only, before they are folded. Catalyst broadcasts the keys if they are few."""
    return events.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def spans(events: DataFrame, order: list[str], query: TraceQuery = TraceQuery(), patches: DataFrame | None = None, tombstones: DataFrame | None = None, tombstone_keys: list[str] | None = None, keys: DataFrame | None = None, scope: str = "span", window_mode: str = "events") -> DataFrame:
    """The visible spans of a snapshot.

    ``window_mode='events'`` folds the events within the time window; ``'spans'`` folds all events of the spans that have
    one in it. The tenant is asked of folded and patched spans, as any event or patch may set it.
    """
    if window_mode == "spans" and (query.time_from is not None or query.time_to is not None):
        hit = query.events(events)
        events = TraceQuery(trace_id=query.trace_id).events(events)
        events = only_keys(events, hit)
    else:
        events = query.events(events)
    if tombstones is not None:
        events = drop_tombstones(events, tombstones, tombstone_keys or ["segment_id", "row_idx"])
    if keys is not None:
        events = only_keys(events, keys)
    out = fold(events, order, scope)
    if patches is not None:
        out = apply_patches(out, patches)
    if query.tenant_id is not None:
        out = out.filter(F.col("tenant_id") == query.tenant_id)
    return out


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted by ids as unsigned numbers."""
    return df.orderBy(*(unsigned_order(F.col(k)) for k in keys))
