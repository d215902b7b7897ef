"""Every query of the trace engine against its SQL; identities, store and wire format against known values."""

import json
import random
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ids
from spanloom.operators import fold, graph
from spanloom.plans import catalog
from spanloom.sources.store import FormatError, TraceStore
from spanloom.sources import wire


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(name, same_rows):
    same_rows(catalog.QUERIES[name], catalog.ORACLE[name])


def test_queries_without_sql_are_tested_otherwise():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"vector_ann", "harness", "session_harness"}


@pytest.mark.parametrize("name,seq,kind,want", [("demo-span", 7, 2, 16098495313036060864), ("1002-1", 1, 1, 3941713543033365492), ("反洗钱-1", 3, 3, 13462389519714918643)])
def test_event_id_golden(spark, name, seq, kind, want):
    df = spark.createDataFrame([(name, seq, kind)], "e string, s long, t int")
    assert df.select(ids.render(ids.event_id(F.col("e"), F.col("s"), F.col("t")))).first()[0] == str(want)


def test_event_ids_against_plain_python(spark, sf):
    def fnv(data: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
        return h

    for r in catalog.QUERIES["event_ids"](spark, sf).collect():
        want = fnv(r.ext_span_id.encode() + int(r.seq).to_bytes(8, "little") + bytes([r.event_type]))
        assert r.event_id % (1 << 64) == want


EVENTS = "trace_id long, span_id long, ts long, seq long, event_type smallint, ext_span_id string, status smallint, input_text string, logs array<string>, src_row long"


def test_fold_last_non_null_and_empty(spark):
    rows = [(1, 1, 5, 2, 2, "a", 1, None, ["y", "x"], 2), (1, 1, 4, 1, 1, "a", 0, "in", ["x"], 1), (1, 1, 9, 2, 2, "a", 0, "late copy", None, 3)]
    r = fold.spans(spark.createDataFrame(rows, EVENTS), ["src_row"]).first()
    assert (r.status, r.input_text, r.logs, r.event_count) == (1, "in", ["x", "y"], 2)
    assert fold.spans(spark.createDataFrame([], EVENTS), ["src_row"]).count() == 0


def test_depth_and_preorder_of_odd_trees(spark):
    spans = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 99), (1, 5, 6), (1, 6, 5), (1, 7, 7)], "trace_id long, span_id long, parent_span_id long")
    depth = {r.span_id: r.depth for r in graph.trace_depth(spans).collect()}
    assert depth == {1: 0, 2: 1, 3: 2, 4: 1, 5: 65, 6: 65, 7: 65}
    assert {r.span_id: r.visit for r in graph.trace_dfs(spans).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


TREE = "trace_id long, span_id long, parent_span_id long"


def test_preorder_of_a_chain_of_300(spark):
    rows = [(1, i, i - 1 if i > 1 else None) for i in range(1, 301)] + [(1, 400, 401), (1, 401, 400), (2, 1, None)]
    for in_task in (1_000_000, 100):
        got = graph.trace_dfs(spark.createDataFrame(rows, TREE), in_task).collect()
        assert {(r.trace_id, r.span_id): r.visit for r in got} == {(1, i): i - 1 for i in range(1, 301)} | {(2, 1): 0}


def plain_walk(rows):
    """Depth and preorder by recursion over dicts."""
    by, depth, visit = {}, {}, {}
    for t, s, p in rows:
        by.setdefault(t, {})[s] = p
    for t, spans in by.items():
        for s in spans:
            d, at = 0, s
            while at in spans and spans[at] is not None and d < graph.MAX_DEPTH:
                d, at = d + 1, spans[at]
            depth[t, s] = d
        kids = {}
        for s, p in spans.items():
            kids.setdefault(p if p in spans else None, []).append(s)
        stack, n = sorted(kids.get(None, []), key=lambda x: -(x % (1 << 64))), 0
        while stack:
            s = stack.pop()
            visit[t, s], n = n, n + 1
            stack += sorted(kids.get(s, []), key=lambda x: -(x % (1 << 64)))
    return depth, visit


@pytest.mark.parametrize("in_task", [1_000_000, 12, 1])
def test_random_forests_in_one_task_and_by_joins(spark, in_task):
    rng = random.Random(5)
    rows = []
    for t in range(12):
        ids = rng.sample(range(-40, 40), rng.randint(1, 30))
        rows += [(t - 3, s, rng.choice([None, 99, *ids])) for s in ids]
    rows += [(70, k, 0 if k else None) for k in range(40)]
    depth, visit = plain_walk(rows)
    spans = spark.createDataFrame(rows, TREE).repartition(5)
    assert {(r.trace_id, r.span_id): r.depth for r in graph.trace_depth(spans, in_task=in_task).collect()} == depth
    assert {(r.trace_id, r.span_id): r.visit for r in graph.trace_dfs(spans, in_task).collect()} == visit


def test_trees_compute_their_spans_once(spark, sf):
    plan = catalog.QUERIES["trace_dfs"](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") <= 2


def test_store_versions_idempotence_and_compaction(spark, tmp_path):
    store = TraceStore(spark, f"file://{tmp_path}/store")
    rows = [(t, 1, t, 1, 1, f"{t}-1", 0, None, None, t) for t in range(6)]
    ev = spark.createDataFrame(rows, EVENTS)
    store.append(ev.filter("trace_id < 3"), order=["src_row"], batch=("s", 0))
    store.append(ev.filter("trace_id < 3"), order=["src_row"], batch=("s", 0))
    pinned = store.append(ev.filter("trace_id >= 3"), order=["src_row"], batch=("s", 1))
    assert store.spans().count() == 6
    store.delete(store.events().filter("trace_id = 2").select("segment_id", "row_idx"))
    store.upgrade(spark.createDataFrame([(4, 1, 900, "good")], "trace_id long, span_id long, eval_score int, eval_label string"))
    before = sorted(map(str, store.spans().collect()))
    assert store.spans(version=pinned).count() == 6
    assert len(before) == 5
    store.compact()
    assert sorted(map(str, store.spans().collect())) == before
    store.backup(f"file://{tmp_path}/copy")
    assert sorted(map(str, TraceStore(spark, f"file://{tmp_path}/copy").spans().collect())) == before
    store.vacuum()
    assert sorted(map(str, store.spans().collect())) == before
    newest = store.manifest()
    store.files.publish(f"manifest/v{newest['version'] + 1:012d}.json", json.dumps(newest | {"format": 99, "version": newest["version"] + 1}))
    with pytest.raises(FormatError):
        TraceStore(spark, f"file://{tmp_path}/store")


@contextmanager
def without_llm() -> Iterator[None]:
    """As if the folders of the training-data operators had been deleted."""
    saved = {k: sys.modules.pop(k) for k in list(sys.modules) if k in ("__spark_entry__", "corpus_pipeline") or k.startswith("spanloom.llm")}
    sys.modules |= {"spanloom.llm": None, "corpus_pipeline": None}
    try:
        yield
    finally:
        for k in ("__spark_entry__", "spanloom.llm", "corpus_pipeline"):
            sys.modules.pop(k, None)
        sys.modules.update(saved)


def test_entry_without_training_operators():
    with without_llm():
        import __spark_entry__ as entry

        assert set(entry.queries()) == set(catalog.QUERIES)
        assert set(entry.oracle_sql()) == set(catalog.ORACLE)
        assert not any(k.startswith("spanloom.llm") and m for k, m in sys.modules.items())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_wire_round_trip_keeps_odd_values(spark):
    ev = spark.createDataFrame([(1, -1, 2, 3, 2, 'q"\\ü', None, None, ["", "b"], 0)], EVENTS).drop("src_row")
    back = wire.parse_wire(wire.to_wire(ev)).first()
    assert (back.trace_id, back.span_id, back.ext_span_id, back.status, back.logs) == (1, -1, 'q"\\ü', None, ["", "b"])


def test_otlp_attributes_are_read_once(spark):
    """The plan looks at an attribute a fixed number of times, not once for every value and name that it may carry."""
    from spanloom.sources.otlp import parse_otlp

    own = lambda k, v: {"key": k, "value": v}
    span = {"traceId": "1", "spanId": "2", "name": "n", "attributes": [own("llm.model_name", {"stringValue": 5}), own("gen_ai.response.model", {"string_value": "m"}), own("gen_ai.response.model", {"stringValue": "second"}), own(7, {"stringValue": "x"}), own("llm.token_count.prompt", {"doubleValue": 3.0})]}
    df = parse_otlp(spark.createDataFrame([(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}),)], "body string"))
    assert [(r.model, r.input_tokens, r.logs) for r in df.orderBy("seq").collect()] == [("m", 3, ["n"]), (None, None, [])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    print(plan.count("variant_get("))
    assert plan.count("variant_get(") < 100


def test_a_stream_knows_events_by_their_columns(spark, tmp_path):
    """No hash of each event, and the session's settings as they were."""
    from spanloom.streaming import ingest

    plan = ingest.session_totals(ingest.event_stream(spark, str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark [ext_span_id" in plan and "aggregate(" not in plan
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with ingest.state_on_disk(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before
