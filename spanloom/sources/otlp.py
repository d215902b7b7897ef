"""OTLP/HTTP JSON traces: each span becomes a start and an end event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import fnv1a64, hex_low
from spanloom.sources.schema import EVENTS

#: For each value the attributes that may carry it, the first that is there wins.
ALIASES = {
    "model": ["gen_ai.request.model", "gen_ai.response.model", "llm.model_name"],
    "input_tokens": ["gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt"],
    "output_tokens": ["gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion"],
    "agent_name": ["gen_ai.agent.name", "agent.name"],
    "tool_name": ["gen_ai.tool.name", "tool.name"],
    "input_text": ["input.value", "gen_ai.prompt"],
    "output_text": ["output.value", "gen_ai.completion"],
    "session": ["session.id", "gen_ai.conversation.id", "session_id"],
}
BODIES = ["gen_ai.prompt", "gen_ai.completion", "gen_ai.event.content", "content", "message"]


def _get(v: Column, *names: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", "variant") for n in names))


def _let(value: Column, f) -> Column:
    """A function of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _string(v: Column) -> Column:
    return _let(v, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _long(v: Column) -> Column:
    """A number or a numeric string; a double only if it is whole."""
    whole = lambda t: _let(t.try_cast("double"), lambda d: F.when(d == F.floor(d), d.try_cast("bigint")))
    return _let(F.try_variant_get(v, "$", "string"), lambda t: F.coalesce(t.try_cast("bigint"), whole(t)))


def _array(v: Column) -> Column:
    return F.coalesce(v.try_cast("array<variant>"), F.array().cast("array<variant>"))


def _attributes(v: Column) -> Column:
    """An array of attributes as structs of key, string and long: each is read once, whatever is asked of them."""

    def read(a: Column) -> Column:
        own = lambda x: F.struct(_string(_get(a, "key")).alias("key"), _string(_get(x, "stringValue", "string_value")).alias("string"), _long(_get(x, "intValue", "int_value", "doubleValue", "double_value")).alias("long"))
        return _let(_get(a, "value"), own)

    return F.transform(_array(v), read)


def _attribute(attributes: Column, names: list[str], kind: str) -> Column:
    """The value of the first name that has one of the kind."""
    value = lambda name: F.get(F.filter(attributes, lambda a: a["key"] == name), 0)[kind]
    return F.coalesce(*map(value, names))


def flatten_messages(text: Column) -> Column:
    """The contents of a JSON message or array of messages, joined by line ends; another text as it is."""

    def contents(m: Column) -> Column:
        parts = lambda c: F.filter(F.transform(_array(c), lambda p: _string(_get(p, "text"))), lambda x: x.isNotNull())
        return _let(_get(m, "content"), lambda c: _let(_string(c), lambda s: F.when(s.isNotNull(), F.array(s)).otherwise(parts(c))))

    def joined(t: Column) -> Column:
        found = _let(F.try_parse_json(t), lambda v: F.flatten(F.transform(F.coalesce(v.try_cast("array<variant>"), F.array(v)), contents)))
        return _let(found, lambda x: F.when(F.coalesce(F.size(x), F.lit(0)) > 0, F.array_join(x, "\n")))

    return _let(text, lambda t: F.when(t.rlike(r"^\s*[\[{]"), F.coalesce(joined(t), t)).otherwise(t))


def _events(v: Column) -> Column:
    """Span events as structs of the name in lower case and the text."""
    body = lambda e: _let(_attributes(_get(e, "attributes")), lambda a: _attribute(a, BODIES, "string"))
    return F.transform(_array(v), lambda e: F.struct(F.lower(F.coalesce(_string(_get(e, "name")), F.lit(""))).alias("name"), body(e).alias("body")))


def _from_events(events: Column, wanted: str, unless: str | None) -> Column:
    """Texts of span events whose name says that they are output, or input."""

    def matches(e: Column) -> Column:
        ok = e["name"].rlike(wanted) & e["body"].isNotNull()
        return ok & ~e["name"].rlike(unless) if unless else ok

    found = F.transform(F.filter(events, matches), lambda e: flatten_messages(e["body"]))
    return _let(found, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")))


def session_number(text: Column) -> Column:
    """A decimal string as the number it is, any other by its hash."""
    number = F.when(text.rlike(r"^\+?\d{1,20}$") & (text.try_cast("decimal(20,0)") <= F.lit("18446744073709551615").cast("decimal(20,0)")), F.conv(F.ltrim(text, F.lit("+")), 10, -10).cast("bigint"))
    return F.when(text.isNotNull(), F.coalesce(number, fnv1a64(F.encode(text, "utf-8"))))


def parse_otlp(bodies: DataFrame, body: str = "body", tenant_id: int | None = None, strict: bool = True) -> DataFrame:
    """The events of each row's export. A body without resourceSpans, or a span without ids, is bad as a whole: ``strict``
    raises, else the body gives no events. Names are in camel or snake case. Columns besides the body come along."""
    rest = [c for c in bodies.columns if c != body]
    # Each step comes out of a generator, so that all that follows shares one evaluation.
    once = lambda df, value, name: df.select(*rest, *(c for c in ("_r",) if c in df.columns and c != name), F.explode(F.array(value)).alias(name))
    parsed = once(bodies, F.try_parse_json(F.col(body)), "_v")
    root = once(parsed, _get(F.col("_v"), "resourceSpans", "resource_spans"), "_r")
    root = once(root, F.flatten(F.transform(_array(F.col("_r")), lambda r: F.flatten(F.transform(_array(_get(r, "scopeSpans", "scope_spans")), lambda s: _array(_get(s, "spans")))))), "_spans")
    named = lambda s: _string(_get(s, "traceId", "trace_id")).isNotNull() & _string(_get(s, "spanId", "span_id")).isNotNull()
    good = F.coalesce(F.col("_r").isNotNull() & F.forall("_spans", lambda s: F.coalesce(named(s), F.lit(False))), F.lit(False))
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.lit("an OTLP body without resourceSpans or with a span without ids")).cast("boolean"))
    rows = root.filter(good).select(*rest, F.explode("_spans").alias("_s"))
    s = F.col("_s")
    parts = once(
        rows,
        F.struct(
            _string(_get(s, "traceId", "trace_id")).alias("_trace"), _string(_get(s, "spanId", "span_id")).alias("_span"), F.coalesce(_string(_get(s, "parentSpanId", "parent_span_id")), F.lit("")).alias("_parent"),
            F.coalesce(_string(_get(s, "name")), F.lit("")).alias("_name"), F.coalesce(_long(_get(s, "startTimeUnixNano", "start_time_unix_nano")), F.lit(0)).alias("_t0"), _long(_get(s, "endTimeUnixNano", "end_time_unix_nano")).alias("_t1"),
            _long(_get(_get(s, "status"), "code")).alias("_code"), _attributes(_get(s, "attributes")).alias("_a"), _events(_get(s, "events")).alias("_ev"),
        ),
        "_p",
    ).select(*rest, "_p.*")
    a = F.col("_a")
    texts = {c: F.coalesce(flatten_messages(_attribute(a, ALIASES[c], "string")), _from_events(F.col("_ev"), *how)) for c, how in (("output_text", ("completion|assistant|choice", None)), ("input_text", ("prompt|user|system|message", "completion|assistant|choice")))}
    both = {
        "trace_id": hex_low(F.col("_trace")), "span_id": hex_low(F.col("_span")), "ext_span_id": F.col("_span"),
        "parent_span_id": F.when(F.col("_parent") != "", hex_low(F.col("_parent"))), "tenant_id": F.lit(tenant_id),
    }
    end = F.coalesce("_t1", "_t0")
    begin = both | texts | {
        "ts": F.col("_t0"), "seq": F.lit(1), "event_type": F.lit(1), "logs": F.when(F.col("_name") != "", F.array("_name")).otherwise(F.array().cast("array<string>")), "session_id": session_number(_attribute(a, ALIASES["session"], "string")),
    } | {c: _attribute(a, ALIASES[c], "string") for c in ("model", "agent_name", "tool_name")} | {c: _attribute(a, ALIASES[c], "long") for c in ("input_tokens", "output_tokens")}
    finish = both | {"ts": end, "seq": F.lit(2), "event_type": F.lit(2), "status": F.when(F.col("_code") == 2, 1).when(F.col("_code") == 1, 0), "duration_ns": F.greatest(end - F.col("_t0"), F.lit(0)), "logs": F.array().cast("array<string>")}

    def event(values: dict[str, Column]) -> Column:
        return F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS))

    return parts.select(*rest, F.inline(F.array(event(begin), event(finish))))
