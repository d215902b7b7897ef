"""Routes, tracer and exporters, generators and harnesses."""

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from spanloom import evalkit, sdk
from spanloom.api import Service, log_line
from spanloom.sources.store import TraceStore
from spanloom.streaming import ingest


def span(t, s, kind, **kw):
    return {"trace_id": t, "span_id": s, "ts": 1000 + 100 * (t % 100) + s, "seq": kind, "event_type": kind, "ext_span_id": f"{t}-{s}", **kw}


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    own = Service(TraceStore(spark, f"file://{tmp_path_factory.mktemp('api')}/store"), token="secret")
    rows = []
    for t in (1, 2, 1 << 63):
        rows += [span(t, 1, 1, session_id=5, agent_name="planner", input_text="find the parcel", tenant_id=3), span(t, 1, 2, duration_ns=3_000_000, status=0, output_text="found")]
        rows += [span(t, 2, 1, parent_span_id=1, tool_name="lookup", input_tokens=4, tenant_id=3), span(t, 2, 2, duration_ns=1_000_000, status=int(t == 2), output_text="a \"quoted\" 结果")]
    assert own.route("POST", "/v1/ingest", json.dumps(rows)) == (200, '{"ingested": 12}')
    return own


def get(service, path, **kw):
    status, body = service.route("GET", path, **kw)
    assert status == 200, body
    return json.loads(body)


def test_traces_steps_and_details(service):
    traces = get(service, "/v1/traces")
    assert {t["trace_id"] for t in traces} == {1, 2, 1 << 63} and {t["error_count"] for t in traces} == {0, 1}
    one = get(service, f"/v1/traces/{1 << 63}")
    assert one["trace_id"] == 1 << 63 and [(s["span_id"], s["parent_span_id"], s["depth"], s["kind"], s["start_ns"]) for s in one["spans"]] == [(1, None, 0, "agent", 0), (2, 1, 1, "tool", 3_000_000)]
    assert [s["dur_ms"] for s in get(service, "/v1/traces/2/steps")] == [3, 1]
    assert get(service, "/v1/traces/2/spans/2")["output_text"] == 'a "quoted" 结果'
    assert service.route("GET", "/v1/traces/77")[0] == 404 and service.route("GET", "/v1/traces/2/spans/9")[0] == 404


def test_sessions_and_turns(service):
    page = get(service, "/v1/sessions?limit=1")
    assert (page["total"], page["nextCursor"], page["items"][0]["title"]) == (1, None, "planner")
    assert get(service, "/v1/sessions?filter=plan%6Eer")["total"] == 1 and get(service, "/v1/sessions?filter=nobody") == {"items": [], "nextCursor": None, "total": 0}
    assert [t["turn_index"] for t in get(service, "/v1/sessions/5/turns")] == [0, 1, 2]


def test_search_dispatch(service):
    ask = lambda **kw: service.route("POST", "/v1/search", json.dumps(kw))
    found = json.loads(ask(text="lookup quoted", k=2)[1])
    assert [h["span_id"] for h in found] == [2, 2] and found[0]["trace_id"] == 1
    assert [h["trace_id"] for h in json.loads(ask(text="lookup", filter={"status": 1})[1])] == [2]
    assert json.loads(ask(text="")[1]) == []
    vectors = service.spark.createDataFrame([(1, 1, [0.0, 1.0]), (2, 1, [1.0, 0.0])], "trace_id long, span_id long, embedding array<float>")
    service.store.index_embedding(vectors)
    assert [h["trace_id"] for h in json.loads(ask(vector=[1, 0])[1])] == [2, 1]
    assert [h["trace_id"] for h in json.loads(ask(text="parcel", vector=[1, 0], k=2)[1])] == [1, 2]
    for bad in ("", "[]", '{"k": "x"}'):
        assert service.route("POST", "/v1/search", bad)[0] == 400


def test_a_tenant_sees_its_own(service):
    assert get(service, "/v1/traces", tenant=4) == [] and len(get(service, "/v1/traces", tenant=3)) == 3
    assert json.loads(service.route("POST", "/v1/search", '{"text": "parcel"}', 4)[1]) == []
    own = Service(TraceStore(service.spark, service.store.path + "-tenant"))
    own.handle("POST", "/v1/ingest", json.dumps([span(1, 1, 1, tenant_id=9)]), {"X-Tenant-Id": "2"})
    assert len(get(own, "/v1/traces", tenant=2)) == 1 and get(own, "/v1/traces", tenant=9) == []


def test_the_gate(service):
    ok = {"Authorization": "Bearer secret"}
    assert service.handle("GET", "/v1/metrics", b"", ok)[0] == 200
    assert service.handle("GET", "/v1/metrics")[0] == 401 and service.handle("GET", "/nowhere", b"", ok)[0] == 404
    assert service.handle("POST", "/v1/ingest", gzip.compress(b"[]"), ok | {"Content-Encoding": "gzip"}) == (200, '{"ingested": 0}')
    assert service.handle("POST", "/v1/ingest", b"x", ok | {"Content-Encoding": "br"})[0] == 415
    assert service.handle("POST", "/v1/ingest", b"no gzip", ok | {"Content-Encoding": "gzip"})[0] == 400
    small = Service(service.store, max_body=10)
    assert small.handle("POST", "/v1/ingest", b" " * 11)[0] == 413
    assert small.handle("POST", "/v1/ingest", gzip.compress(b" " * 5000)[:10], {"Content-Encoding": "gzip"})[0] in (400, 413)
    assert service.handle("POST", "/v1/ingest", b"[{}]", ok)[0] == 400 and service.handle("GET", "/v1/traces/x", b"", ok)[0] == 400
    assert service.handle("POST", "/v1/traces", b"{}", ok)[0] == 400
    body = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "0" * 31 + "7", "spanId": "0" * 15 + "8", "name": "step"}]}]}]}
    assert json.loads(service.handle("POST", "/v1/traces", json.dumps(body), ok)[1]) == {"partialSuccess": {}}
    assert get(service, "/v1/traces/7")["spans"][0]["span_id"] == 8
    assert log_line("x", a=1, b='p "q"') == 'event=x a=1 b="p \\"q\\""'


def test_tracer_through_a_folder_and_a_stream(spark, tmp_path):
    out = sdk.Folder(f"{tmp_path}/in", size=3)
    tracer = sdk.Tracer(out, tenant_id=6)
    with tracer.trace("job", session_id=12, agent_name="planner") as root:
        with root.span("look", tool_name="lookup", input_text="q") as child:
            child.log("half way")
            child.set(output_text="done", output_tokens=3)
        with pytest.raises(KeyError), root.span("fails"):
            raise KeyError
    out.close()
    store = TraceStore(spark, f"file://{tmp_path}/store")
    ingest.run(ingest.wire_stream(spark, f"{tmp_path}/in"), store, f"{tmp_path}/checkpoint")
    by = {r.logs[0]: r for r in store.spans().collect()}
    assert set(by) == {"job", "look", "fails"} and {r.tenant_id for r in by.values()} == {6} and {r.session_id for r in by.values()} == {12}
    assert by["look"].logs == ["look", "half way"] and (by["look"].output_text, by["look"].output_tokens, by["look"].event_count) == ("done", 3, 3)
    assert by["look"].parent_span_id == by["job"].span_id and (by["fails"].status, by["job"].status) == (1, 0)


def test_exporters_and_ids(capsys):
    sdk.Console().export({"a": "ü"})
    assert capsys.readouterr().out == '{"a": "ü"}\n'
    got = []
    batch = sdk.Batch(got.append, 2)
    for i in range(5):
        batch.export({"i": i})
    batch.close()
    assert [len(b) for b in got] == [2, 2, 1]
    ids = sdk.SnowflakeIds(5, iter([1e10] * 5000 + [9e9] * 5000).__next__)
    made = [ids() for _ in range(10_000)]
    assert made == sorted(set(made)) and {i >> 12 & 1023 for i in made} == {5}
    with sdk.Tracer(own := sdk.Collecting()).trace("x"):
        pass
    assert [e["event_type"] for e in own.events] == [1, 2]


def test_http_exporter():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out = sdk.Http(f"http://127.0.0.1:{server.server_port}/v1/ingest", "t")
    out.export({"a": 1})
    out.close()
    server.shutdown()
    assert got == [("Bearer t", [{"a": 1}])]


def test_harness_finds_what_was_made_to_fail(spark, tmp_path):
    rows = {r.scenario: r for r in evalkit.run_harness(TraceStore(spark, f"file://{tmp_path}/a"), 80).collect()}
    assert set(rows) == {s.key for s in evalkit.SCENARIOS} | {"regression", "regression stricter"}
    for s in evalkit.SCENARIOS:
        r = rows[s.key]
        assert (r.traces, r.scored - r.passed) == (80, r.injected_failures) and 0 < r.injected_failures < 80
    assert rows["regression"].scored == 80 and rows["regression stricter"].passed < rows["regression"].passed


def test_conversations_are_labelled_by_their_arcs(spark, tmp_path):
    rows = {(r.arc, r.label): r for r in evalkit.run_session_harness(TraceStore(spark, f"file://{tmp_path}/b"), 300).collect()}
    assert {k: r.avg_turns for k, r in rows.items()} == {("fast", "一次到位"): 1, ("retry", "绕圈后解决"): 3, ("repeat", "绕圈后解决"): 2, ("unresolved", "未解决"): 3}
    assert sum(r.sessions for r in rows.values()) == 300
    assert all(abs(r.sessions / 300 - dict(evalkit.ARCS)[arc]) < 0.12 for (arc, _), r in rows.items())
    once = evalkit.conversation_events(spark, 50, 3)
    assert once.exceptAll(evalkit.conversation_events(spark, 50, 3).repartition(3)).count() == 0
