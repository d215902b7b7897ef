"""SDK wire JSON: arrays of events, whole batches or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import parse_unsigned
from spanloom.sources.schema import EVENTS

REQUIRED = ("trace_id", "span_id", "ts", "seq", "event_type", "ext_span_id")
_WIDE = ("trace_id", "span_id", "ts", "seq", "duration_ns", "parent_span_id", "input_tokens", "output_tokens", "session_id", "tenant_id")
_TEXT = ("ext_span_id", "agent_name", "tool_name", "model", "input_text", "output_text")
#: Scores come from evaluation only, never over the wire.
_SCORES = {"eval_score": "int", "eval_label": "string"}


def _text(item: Column, name: str) -> Column:
    """A string value; null for another type."""
    return F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def _integer(item: Column, name: str) -> Column:
    """A number or a numeric string, up to the unsigned 64-bit range, as its bit pattern; what else a value may be doesn't read as one."""
    return parse_unsigned(F.try_variant_get(item, f"$.{name}", "string"))


def _byte(value: Column) -> Column:
    return value.bitwiseAND(F.lit(255)).cast("smallint")


def parse_wire(batches: DataFrame, body: str = "body", tenant_id: int | None = None, override_tenant: bool = False, strict: bool = True) -> DataFrame:
    """The events of each row's JSON array. Columns besides the body come along.

    A batch that isn't an array of objects with all required fields is bad as a whole: ``strict`` raises, else it gives no
    events. Optional values of a wrong type are null. ``override_tenant`` puts the caller's tenant, null too, in place.
    """
    rest = [c for c in batches.columns if c != body]
    parsed = batches.withColumn("_v", F.try_parse_json(F.col(body)))
    is_array = F.coalesce(F.schema_of_variant("_v").startswith("ARRAY"), F.lit(False))

    def event(e: Column) -> Column:
        values: dict[str, Column] = {c: _integer(e, c) for c in _WIDE} | {c: _text(e, c) for c in _TEXT}
        values["event_type"], values["status"] = _byte(_integer(e, "event_type")), _byte(_integer(e, "status"))
        logs = F.try_variant_get(e, "$.logs", "variant").try_cast("array<variant>")
        values["logs"] = F.coalesce(F.transform(F.filter(logs, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>"))
        if override_tenant:
            values["tenant_id"] = F.lit(tenant_id).cast("bigint")
        return F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS))

    events = F.transform(F.when(is_array, F.expr("try_cast(_v as array<variant>)")), event)
    # Out of a generator, so that the test and the rows below share one evaluation.
    rows = parsed.select(*rest, F.explode(F.array(events)).alias("_events"))

    def complete(e: Column) -> Column:
        ok = F.lit(True)
        for c in REQUIRED:
            ok = ok & e[c].isNotNull()
        return ok

    good = F.coalesce(F.forall("_events", complete), F.lit(False))
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.lit("a wire batch that isn't a JSON array of complete events")).cast("boolean"))
    return rows.filter(good).select(*rest, F.inline("_events"))


def to_wire(events: DataFrame, size: int = 256) -> DataFrame:
    """Events as wire batches of up to ``size``, for exporters: one JSON array in a row."""
    numbered = events.withColumn("_b", F.floor(F.monotonically_increasing_id() / size))
    return numbered.groupBy("_b").agg(F.to_json(F.collect_list(F.struct(*[c for c in events.columns if c not in _SCORES]))).alias("body")).select("body")
