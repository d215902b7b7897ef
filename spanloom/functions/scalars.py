"""Small column functions of the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    return F.round(input_tokens * F.lit(8e-7) + output_tokens * F.lit(4e-6), 3)


def title(text: Column, most: int = 40) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def millis(ns: Column) -> Column:
    """Whole milliseconds, by integer division."""
    return F.call_function("div", ns, F.lit(1_000_000))


def kind(agent: Column, tool: Column, model: Column) -> Column:
    return F.when(agent.isNotNull(), "agent").when(tool.isNotNull(), "tool").when(model.isNotNull(), "llm").otherwise("other")


def name(agent: Column, tool: Column, model: Column, span_id: Column) -> Column:
    return F.coalesce(agent, tool, model, F.concat(F.lit("span "), span_id.cast("string")))


def status_label(status: Column) -> Column:
    return F.when(F.coalesce(status, F.lit(0)) != 0, "error").otherwise("ok")


def clamp_score(score: Column) -> Column:
    return F.least(score, F.lit(1000)).cast("int")


def rfc3339(ts_ns: Column) -> Column:
    """UTC (the session's time zone has to be that) with whole milliseconds, later digits cut."""
    return F.date_format(F.timestamp_micros(F.call_function("div", ts_ns, F.lit(1000))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
