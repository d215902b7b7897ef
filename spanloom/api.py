"""The routes of a trace service as functions of a store: a method, a path and a body in, a status and a text out.

A server only has to pass requests on. Every read takes one version of the store; a tenant, once given, is asked of every
row. Answers are pages or single traces, so what comes to the driver is bounded by them.
"""

from __future__ import annotations

import gzip
import io
import hmac
import json
import logging
import time
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import parse_unsigned, render
from spanloom.operators import graph, views
from spanloom.operators.fold import TraceQuery
from spanloom.operators.search import SearchFilter
from spanloom.sources.otlp import parse_otlp
from spanloom.sources.store import TraceStore
from spanloom.sources.wire import parse_wire

MAX_BODY = 16 << 20
log = logging.getLogger("spanloom.api")


def log_line(event: str, **values) -> str:
    """A line of ``key=value`` pairs; values with blanks, quotes or equal signs are quoted."""
    text = lambda v: json.dumps(v, ensure_ascii=False) if not (s := str(v)) or any(c in s for c in ' "=\n') else s
    return " ".join(f"{k}={text(v)}" for k, v in {"event": event, **values}.items())


class BadRequest(ValueError):
    """A request that can't be answered, with the status to answer."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


class Service:
    def __init__(self, store: TraceStore, token: str | None = None, max_body: int = MAX_BODY):
        self.store, self.spark, self.token, self.max_body = store, store.spark, token, max_body

    # requests

    def body(self, data: bytes | str, encoding: str | None = None) -> str:
        """A request's body as text: plain or gzip, up to the largest size, which holds for what comes out of gzip too."""
        data = data.encode() if isinstance(data, str) else data
        if len(data) > self.max_body:
            raise BadRequest(413, "the body is too large")
        if encoding not in (None, "", "identity", "gzip"):
            raise BadRequest(415, f"the encoding {encoding} is unknown")
        if encoding == "gzip":
            try:
                with gzip.open(io.BytesIO(data)) as f:
                    data = f.read(self.max_body + 1)
            except (OSError, EOFError) as e:
                raise BadRequest(400, "the body is no gzip") from e
            if len(data) > self.max_body:
                raise BadRequest(413, "the body is too large")
        try:
            return data.decode()
        except UnicodeDecodeError as e:
            raise BadRequest(400, "the body is no UTF-8") from e

    def handle(self, method: str, path: str, data: bytes | str = b"", headers: dict[str, str] | None = None) -> tuple[int, str]:
        """Checks who asks and what is sent, then routes; the tenant is a header's, never the body's."""
        sent, began = {k.lower(): v for k, v in (headers or {}).items()}, time.perf_counter()
        try:
            if self.token is not None and not hmac.compare_digest(sent.get("authorization", ""), f"Bearer {self.token}"):
                raise BadRequest(401, "not authorized")
            tenant = sent.get("x-tenant-id")
            if tenant is not None and not tenant.isdigit():
                raise BadRequest(400, "the tenant is no number")
            status, out = self.route(method, path, self.body(data, sent.get("content-encoding")), None if tenant is None else signed(tenant))
        except BadRequest as e:
            status, out = e.status, json.dumps({"error": str(e)})
        log.info(log_line("request", method=method, path=path, status=status, bytes=len(out), ms=round(1000 * (time.perf_counter() - began))))
        return status, out

    def route(self, method: str, path: str, body: str = "", tenant: int | None = None) -> tuple[int, str]:
        at = urlsplit(path)
        asked = {k: v[0] for k, v in parse_qs(at.query).items()}
        parts = [unquote(p) for p in at.path.split("/") if p]
        match method, parts:
            case "POST", ["v1", "ingest"]:
                return self._append(lambda b: parse_wire(b, tenant_id=tenant, override_tenant=tenant is not None), body, lambda n: {"ingested": n})
            case "POST", ["v1", "traces"]:
                return self._append(lambda b: parse_otlp(b, tenant_id=tenant), body, lambda n: {"partialSuccess": {}})
            case "POST", ["v1", "search"]:
                return self.search(body, tenant)
            case "GET", ["v1", "metrics"]:
                return 200, self.store.prometheus()
            case "GET", ["v1", "traces"]:
                return 200, rows(numbered(views.list_traces(self.spans(tenant)), "trace_id"))
            case "GET", ["v1", "sessions"]:
                return self.sessions(asked, tenant)
            case "GET", ["v1", "sessions", session, "turns"]:
                found = views.session_turns(self.spans(tenant).filter(F.col("session_id") == number(session))).orderBy("turn_index")
                return 200, rows(numbered(found, "session_id", "trace_id"))
            case "GET", ["v1", "traces", trace]:
                return one(trace_document(self.spans(tenant, number(trace))))
            case "GET", ["v1", "traces", trace, "steps"]:
                return 200, rows(numbered(views.steps(self.spans(tenant, number(trace))), "trace_id", "span_id"))
            case "GET", ["v1", "traces", trace, "spans", span]:
                return one(numbered(views.span_detail(self.spans(tenant, number(trace)), number(trace), number(span)), "trace_id", "span_id"))
        return 404, json.dumps({"error": "not found"})

    # routes

    def spans(self, tenant: int | None = None, trace: int | None = None) -> DataFrame:
        return self.store.spans(TraceQuery(trace_id=trace, tenant_id=tenant))

    def _append(self, parse, body: str, answer) -> tuple[int, str]:
        try:
            events = parse(self.spark.createDataFrame([(body,)], "body string")).cache()
            n = events.count()
        except PySparkException as e:
            return 400, json.dumps({"error": str(e).split("\n")[0].replace('"', "'")[:300]})
        try:
            if n:
                self.store.append(events)
                self.store.index_text()
        finally:
            events.unpersist()
        return 200, json.dumps(answer(n))

    def search(self, body: str, tenant: int | None = None) -> tuple[int, str]:
        """Text, vector or both, by what the body has; the best first."""
        try:
            asked = json.loads(body)
        except ValueError:
            asked = None
        if not isinstance(asked, dict):
            return 400, json.dumps({"error": "the body is no JSON object"})
        text, vector, wanted = asked.get("text") or "", asked.get("vector") or [], asked.get("filter") or {}
        k = asked.get("k", 10)
        if not isinstance(k, int) or not isinstance(wanted, dict) or not isinstance(vector, list) or not isinstance(text, str):
            return 400, json.dumps({"error": "text, vector, k or filter is of a wrong type"})
        whole = lambda n: signed(v) if (v := wanted.get(n)) is not None and str(v).lstrip("-").isdigit() else None
        chosen = SearchFilter(trace_id=whole("trace_id"), tenant_id=tenant, agent_name=wanted.get("agent_name"), status=whole("status"), time_from=whole("time_from"), time_to=whole("time_to"))
        columns = {"query_id": [0]} | ({"query": [text]} if text or not vector else {}) | ({"vector": [[float(x) for x in vector if isinstance(x, (int, float))]]} if vector else {})
        kinds = {"query_id": "int", "query": "string", "vector": "array<float>"}
        queries = self.spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} {kinds[c]}" for c in columns))
        found = self.store.search(queries, max(0, min(k, 1000)), chosen if chosen != SearchFilter() else None)
        score = F.round("score" if "score" in found.columns else "distance", 4).alias("score")
        return 200, rows(numbered(found.orderBy("rank").select("trace_id", "span_id", score, "status", "duration_ns", "agent_name", "logs"), "trace_id", "span_id"))

    def sessions(self, asked: dict[str, str], tenant: int | None = None) -> tuple[int, str]:
        whole = lambda n, d: int(asked[n]) if asked.get(n, "").isdigit() else d
        cursor, limit = whole("cursor", 0), whole("limit", 50)
        found = views.sessions_page(self.spans(tenant), None, cursor, limit) if not asked.get("filter") else views.sessions_page(self.spans(tenant), asked["filter"].replace("%", "%25"), cursor, limit)
        page = [json.loads(x[0]) for x in numbered(found, "session_id", "first_trace_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        page.sort(key=lambda x: -x["session_id"])
        out = {"items": [{k: v for k, v in x.items() if k not in ("total", "next_cursor")} for x in page], "nextCursor": page[0]["next_cursor"] if page else None, "total": page[0]["total"] if page else 0}
        return 200, json.dumps(out, ensure_ascii=False)


def signed(text: object) -> int:
    """The bits of an unsigned number as a BIGINT."""
    n = int(str(text)) & ((1 << 64) - 1) if not str(text).startswith("-") else int(str(text))
    return n - (1 << 64) if n >= 1 << 63 else n


def number(text: str) -> int:
    if not text.isdigit() or int(text) >= 1 << 64:
        raise BadRequest(400, f"{text} is no id")
    return signed(text)


def numbered(df: DataFrame, *ids: str) -> DataFrame:
    """Ids as the unsigned numbers that they are, in the order of the first where nothing else orders."""
    return df.withColumns({c: render(F.col(c)).cast("decimal(20,0)") for c in ids})


def rows(df: DataFrame) -> str:
    return "[" + ",".join(x[0] for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()) + "]"


def one(df: DataFrame) -> tuple[int, str]:
    found = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).head(1)
    return (200, found[0][0]) if found else (404, json.dumps({"error": "not found"}))


def trace_document(spans: DataFrame) -> DataFrame:
    """Each trace with its summary and its spans in order, with depths: what a client draws a waterfall from. For chosen traces."""
    drawn = views.waterfall(spans).join(graph.trace_depth(spans), ["trace_id", "span_id"])
    order = parse_unsigned(render(F.col("span_id"))).bitwiseXOR(F.lit(-(1 << 63)))
    item = F.struct(order.alias("o"), render(F.col("span_id")).cast("decimal(20,0)").alias("span_id"), render(F.col("parent_span_id")).cast("decimal(20,0)").alias("parent_span_id"), "depth", "kind", "name", "status_label", "start_ns", "duration_ns", "input_tokens", "output_tokens")
    listed = drawn.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("o")).alias("spans"))
    return numbered(views.trace_summary(spans).join(listed, "trace_id"), "trace_id")
