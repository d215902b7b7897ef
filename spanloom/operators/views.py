"""Listings over folded spans: traces, sessions, timelines, waterfalls, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import scalars
from spanloom.functions.ids import render, unsigned_order


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _errors() -> Column:
    return F.count_if(F.coalesce(F.col("status"), F.lit(0)) != 0)


def list_traces(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.count("*").alias("span_count"), _sum("duration_ns").alias("total_duration_ns"), F.coalesce(F.max("duration_ns"), F.lit(0)).alias("max_duration_ns"), _errors().alias("error_count"), _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"))


def list_sessions(spans: DataFrame) -> DataFrame:
    own = spans.filter(F.col("session_id").isNotNull())
    return own.groupBy("session_id").agg(F.countDistinct("trace_id").alias("trace_count"), F.count("*").alias("span_count"), _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"))


def console_sessions(spans: DataFrame) -> DataFrame:
    """Per session: title (the first agent by trace and span), traces, tokens, whether any span failed, first trace."""
    own = spans.filter(F.col("session_id").isNotNull())
    first = F.when(F.col("agent_name").isNotNull(), F.struct(unsigned_order(F.col("trace_id")), unsigned_order(F.col("span_id"))))
    out = own.groupBy("session_id").agg(F.min_by("agent_name", first).alias("agent"), F.countDistinct("trace_id").alias("turn_count"), _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"), (_errors() > 0).alias("has_error"), F.min_by("trace_id", unsigned_order(F.col("trace_id"))).alias("first_trace_id"))
    return out.withColumn("title", F.coalesce("agent", F.concat(F.lit("会话 "), render(F.col("session_id"))))).drop("agent")


def sessions_page(spans: DataFrame, contains: str | None = None, cursor: int = 0, limit: int = 50) -> DataFrame:
    """A page of console sessions, last session first, with cost, total and the next cursor (null at the end)."""
    limit = min(500, max(1, limit))
    all_ = console_sessions(spans)
    if contains:
        wanted = F.url_decode(F.lit(contains))
        all_ = all_.filter(F.col("title").contains(wanted) | render(F.col("session_id")).contains(wanted))
    total = all_.agg(F.count("*").alias("total"))
    page = all_.orderBy(F.desc(unsigned_order(F.col("session_id")))).offset(cursor).limit(limit)
    out = page.crossJoin(total)
    after = F.when(F.lit(cursor + limit) < F.col("total"), F.lit(cursor + limit)).cast("bigint")
    return out.withColumns({"cost": scalars.cost(F.col("input_tokens"), F.col("output_tokens")), "title": scalars.title(F.col("title")), "next_cursor": after})


def session_timeline(spans: DataFrame) -> DataFrame:
    """The turns of every session: a trace is a turn; only the spans that carry the session count."""
    own = spans.filter(F.col("session_id").isNotNull())
    at = unsigned_order(F.col("span_id"))
    says = F.when(F.col("output_text").isNotNull(), at)
    turns = own.groupBy("session_id", "trace_id").agg(
        F.min_by("input_text", F.when(F.col("input_text").isNotNull(), at)).alias("user_input"),
        F.max_by("output_text", says).alias("agent_output"),
        F.max_by("eval_score", says).alias("eval_score"),
        F.array_sort(F.collect_set("agent_name")).alias("agents"),
        F.count("*").alias("span_count"),
        _errors().alias("error_count"),
        _sum("duration_ns").alias("duration_ns"),
        _sum("input_tokens").alias("input_tokens"),
        _sum("output_tokens").alias("output_tokens"),
    )
    return turns.withColumn("turn_index", F.row_number().over(W.partitionBy("session_id").orderBy(unsigned_order(F.col("trace_id")))) - 1)


def session_totals(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("session_id").agg(F.count("*").alias("turn_count"), _sum("span_count").alias("span_count"), _sum("error_count").alias("error_count"), _sum("duration_ns").alias("duration_ns"), _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"))


def session_turns(spans: DataFrame) -> DataFrame:
    """What a client shows of each turn: name, duration in ms, status, cost."""
    t = session_timeline(spans)
    default = F.concat(F.lit("第"), (F.col("turn_index") + 1).cast("string"), F.lit("轮"))
    return t.select("session_id", "turn_index", "trace_id", scalars.title(F.coalesce("user_input", default)).alias("name"), "user_input", "agent_output", "span_count", "error_count", scalars.millis(F.col("duration_ns")).alias("dur_ms"), F.when(F.col("error_count") > 0, "error").otherwise("ok").alias("status"), "input_tokens", "output_tokens", scalars.cost(F.col("input_tokens"), F.col("output_tokens")).alias("cost"))


def cost_by_agent(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("agent_name").isNotNull()).groupBy("agent_name").agg(F.count("*").alias("span_count"), _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"))


def waterfall(spans: DataFrame) -> DataFrame:
    """Each span with the logical start: the durations of the spans before it in its trace."""
    w = W.partitionBy("trace_id").orderBy(unsigned_order(F.col("span_id"))).rowsBetween(W.unboundedPreceding, -1)
    agent, tool, model = F.col("agent_name"), F.col("tool_name"), F.col("model")
    return spans.select("trace_id", "span_id", "parent_span_id", scalars.kind(agent, tool, model).alias("kind"), scalars.name(agent, tool, model, render(F.col("span_id"))).alias("name"), scalars.status_label(F.col("status")).alias("status_label"), F.coalesce(F.sum("duration_ns").over(w), F.lit(0)).cast("bigint").alias("start_ns"), F.coalesce("duration_ns", F.lit(0)).alias("duration_ns"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), "input_text", "output_text")


def trace_summary(spans: DataFrame) -> DataFrame:
    w = waterfall(spans)
    return w.groupBy("trace_id").agg(F.min_by("name", unsigned_order(F.col("span_id"))).alias("name"), scalars.millis(_sum("duration_ns")).alias("duration_ms"), _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"), F.when(F.count_if(F.col("status_label") == "error") > 0, "error").otherwise("ok").alias("status_label"))


def steps(spans: DataFrame) -> DataFrame:
    return waterfall(spans).select("trace_id", "span_id", "kind", "name", "status_label", scalars.millis(F.col("start_ns")).alias("start_ms"), scalars.millis(F.col("duration_ns")).alias("dur_ms"), "input_text", "output_text")


def span_detail(spans: DataFrame, trace_id: int, span_id: int) -> DataFrame:
    own = spans.filter((F.col("trace_id") == trace_id) & (F.col("span_id") == span_id))
    return own.select("trace_id", "span_id", "input_text", "output_text", F.array_join("logs", "|").alias("logs"), "model", "eval_score", "eval_label")


def filter_attrs(spans: DataFrame, events: DataFrame) -> DataFrame:
    """What search filters ask of a span: folded values, and the time range of its events."""
    times = events.groupBy("trace_id", "span_id").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    return spans.select("trace_id", "span_id", "status", "agent_name", "tenant_id").join(times, ["trace_id", "span_id"])
