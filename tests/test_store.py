"""The store under torn files, several writers, its live tail, its indexes and its evaluation."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from spanloom.operators import evals
from spanloom.operators.fold import TraceQuery
from spanloom.operators.search import SearchFilter
from spanloom.plans import catalog
from spanloom.sources.files import Files, clear_scratch, scratch
from spanloom.sources.store import TraceStore

EVENTS = "trace_id long, span_id long, ts long, seq long, event_type smallint, ext_span_id string, status smallint, agent_name string, output_text string, tenant_id long, b long, a long"


def events(spark, traces, text="plain words"):
    return spark.createDataFrame([(t, 1, 10 * t + s, s, s, f"{t}-1", 0, f"agent{t % 2}", f"{text} {t}" if s == 2 else None, t % 2, -t, s) for t in traces for s in (1, 2)], EVENTS)


def make(spark, tmp_path, **kw):
    return TraceStore(spark, f"file://{tmp_path}/store", **kw)


@pytest.mark.parametrize("torn", ["", "{", '{"version": 3}', "[]"])
def test_a_torn_manifest_is_no_version(spark, tmp_path, torn):
    store = make(spark, tmp_path)
    store.append(events(spark, [1]))
    last = store.append(events(spark, [2]))
    path = tmp_path / "store" / "manifest" / f"v{last + 1:012d}.json"
    path.write_text(torn)
    (path.parent / ".v000000000009.json.dead").write_text("a draft of a writer that died")
    again = make(spark, tmp_path)
    assert again.manifest()["version"] == last and again.versions() == [1, 2]
    with pytest.raises(ValueError):
        again.manifest(last + 1)
    assert again.append(events(spark, [3])) == last + 2
    assert {r.trace_id for r in again.spans().collect()} == {1, 2, 3}


def test_only_torn_manifests_are_an_empty_store(spark, tmp_path):
    (tmp_path / "store" / "manifest").mkdir(parents=True)
    (tmp_path / "store" / "manifest" / "v000000000001.json").write_text("")
    store = make(spark, tmp_path)
    assert store.manifest()["segments"] == [] and store.spans().count() == 0
    assert store.append(events(spark, [1])) == 2 and store.spans().count() == 1


def test_publish_once(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/f")
    assert files.publish("x/a", "1") and not files.publish("x/a", "2")
    assert files.read("x/a") == "1" and files.names("x") == ["a"]


def test_an_order_of_two_columns(spark, tmp_path):
    store = make(spark, tmp_path)
    ev = events(spark, range(40)).repartition(7)
    store.append(ev, order=["b", "a"])
    rows = store.events().orderBy("row_idx").select("b", "a").collect() if "b" in store.events().columns else store.events().orderBy("row_idx").select("trace_id", "seq").collect()
    assert [tuple(r) for r in rows] == [(t, s) for t in range(39, -1, -1) for s in (1, 2)]


def test_concurrent_changes_have_numbers_of_their_own(spark, tmp_path):
    store = make(spark, tmp_path)
    store.append(events(spark, range(8)))
    patch = lambda n: store.upgrade(spark.createDataFrame([(0, 1, 100 + n)], "trace_id long, span_id long, eval_score int"))
    with ThreadPoolExecutor(4) as pool:
        versions = sorted(pool.map(patch, range(4)))
    assert len(set(versions)) == 4
    numbers = [n for _, n in store.manifest()["patches"]]
    assert len(set(numbers)) == 4 and sorted(numbers) == numbers
    by = {v: next(r.eval_score for r in store.spans(version=v).collect() if r.trace_id == 0) for v in versions}
    assert sorted(by.values()) == [100, 101, 102, 103]


def test_live_tail_is_sealed_and_replayed(spark, tmp_path):
    store = make(spark, tmp_path, flush_rows=10)
    store.append(events(spark, [1, 2]))
    first = store.manifest()["segments"][0]["lsn"]
    store.append(events(spark, [3]))
    assert store.metrics()["segments_live"] == 2 and {r.trace_id for r in store.replay(first).collect()} == {3}
    store.delete(store.events().filter("trace_id = 2").select("segment_id", "row_idx"))
    store.append(events(spark, [4, 5]))
    m = store.metrics()
    assert (m["segments"], m["segments_live"], m["rows"]) == (1, 0, 8)
    assert {r.trace_id for r in store.spans().collect()} == {1, 3, 4, 5}
    store.append(events(spark, [6]))
    store.flush()
    assert [x["state"] for x in store.manifest()["segments"]] == ["sealed", "sealed"] and store.spans().count() == 5
    assert "spanloom_segments 2\n" in store.prometheus()
    assert store.vacuum() and store.metrics()["segments_dead"] == 0 and store.spans().count() == 5


def test_text_index_grows_by_segments_and_survives_compaction(spark, tmp_path):
    store = make(spark, tmp_path)
    ask = spark.createDataFrame([(1, "rare words 7"), (2, "nothing")], "query_id int, query string")
    rows = lambda s, **kw: [(r.query_id, r.trace_id, r.span_id, r.score, r.rank) for r in s.search(ask, **kw).collect()]
    store.append(events(spark, range(6), "rare"))
    store.index_text()
    store.append(events(spark, range(3, 12), "common words"))
    assert store.manifest()["text"]["n"] == 6
    store.index_text()
    own = store.manifest()["text"]
    assert own["n"] == 12 and len(own["folders"]) == 2
    found = rows(store, k=5)
    whole = TraceStore(spark, f"file://{tmp_path}/whole")
    whole.append(events(spark, range(6), "rare").unionByName(events(spark, range(6, 12), "common words")))
    whole.index_text(compact=True)
    assert whole.manifest()["text"]["whole"] and rows(whole, k=5) == found
    store.index_text(compact=True)
    store.compact()
    assert store.index_text() and len(store.manifest()["text"]["folders"]) == 1
    assert rows(store, k=5) == found
    assert {r[1] % 2 for r in rows(store, wanted=SearchFilter(tenant_id=1))} == {1}
    store.delete(store.events().filter("trace_id = 7").select("segment_id", "row_idx"))
    assert 7 in {r[1] for r in found} and 7 not in {r[1] for r in rows(store, k=5)}
    with pytest.raises(ValueError):
        store.search(spark.createDataFrame([(1,)], "query_id int"))


@pytest.mark.parametrize("flush", [1 << 40, 10])
def test_text_index_and_replay_go_on_over_sealed_segments(spark, tmp_path, flush):
    """The tail is sealed while part of it is indexed: no event is indexed twice, and rows keep the number of their append."""
    store = make(spark, tmp_path, flush_rows=flush)
    ask = spark.createDataFrame([(1, "rare words 7"), (2, "common")], "query_id int, query string")
    parts = [range(4), range(4, 9), range(7, 14)]
    for n, own in enumerate(parts):
        store.append(events(spark, own, "rare" if n == 1 else "common words"))
        store.index_text()
    assert (len(store.manifest()["segments"]) < 3) == (flush == 10)
    whole = TraceStore(spark, f"file://{tmp_path}/whole")
    whole.append(events(spark, parts[0], "common words").unionByName(events(spark, parts[1], "rare")).unionByName(events(spark, range(9, 14), "common words")))
    whole.index_text()
    assert [store.manifest()["text"][c] for c in ("n", "total")] == [whole.manifest()["text"][c] for c in ("n", "total")]
    rows = lambda s: [(r.query_id, r.trace_id, r.score, r.rank) for r in s.search(ask, 9).collect()]
    assert rows(store) == rows(whole)
    first = store.manifest(1)["segments"][0]["lsn"]
    assert {r.lsn - first: r["count"] for r in store.replay(first).groupBy("lsn").count().collect()} == {1: 10, 2: 14}


@pytest.mark.parametrize("name", ["event_search", "event_search_filtered", "store_replay"])
def test_queries_of_a_store_do_not_depend_on_its_flushes(same_rows, monkeypatch, name):
    for rows in (1, 500):
        monkeypatch.setattr(catalog, "TraceStore", lambda spark, path, n=rows: TraceStore(spark, path, n))
        same_rows(catalog.QUERIES[name], catalog.ORACLE[name])


def test_vectors_of_a_store(spark, tmp_path):
    store = make(spark, tmp_path)
    store.append(events(spark, range(6)))
    v = lambda xs: spark.createDataFrame([(t, 1, [float(t), y]) for t, y in xs], "trace_id long, span_id long, embedding array<float>")
    store.index_embedding(v([(t, 0.0) for t in range(8)]))
    store.index_embedding(v([(2, 9.0)]))
    store.index_vectors(lists=2)
    asked = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, vector array<float>")
    assert [r.trace_id for r in store.search(asked, 3).collect()] == [1, 3, 0]
    assert [r.trace_id for r in store.vector_index().search(asked, 3, probes=2).collect()] == [1, 3, 0]
    both = spark.createDataFrame([(0, "words 5", [2.0, 0.0])], "query_id int, query string, vector array<float>")
    store.index_text()
    assert 5 in {r.trace_id for r in store.search(both, 4).collect()}
    assert store.vacuum() == [] and store.backup(f"file://{tmp_path}/copy")
    copy = TraceStore(spark, f"file://{tmp_path}/copy")
    assert [r.trace_id for r in copy.search(asked, 3).collect()] == [1, 3, 0] and copy.vector_index() is not None


def test_evaluation_through_a_store(spark, tmp_path):
    store = make(spark, tmp_path)
    store.append(events(spark, range(4), "error"))
    store.append(events(spark, range(2, 8), "fine"))
    store.evaluate(evals.keyword_scorer(["error"]), TraceQuery(time_to=1000))
    assert {r.trace_id: r.eval_score for r in store.spans().collect()} == {t: 0 if t < 4 else 1000 for t in range(8)}
    store.collect("bad", "eval_score = 0")
    store.collect("bad", "trace_id < 6")
    store.collect("other", "trace_id = 7")
    assert {r.name: r.examples for r in evals.list_datasets(store.datasets()).collect()} == {"bad": 6, "other": 1}
    assert evals.eval_dataset(store.datasets(), "none", evals.keyword_scorer()) is None


def test_scratch_is_shared_and_cleared(spark):
    path = scratch(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir") + "/spanloom/x-")
    files = Files(spark, path)
    spark.range(3).write.parquet(path)
    assert files.exists("")
    clear_scratch(spark)
    assert not files.exists("")
    catalog._INDEXES.clear()
    catalog._EVENTS.clear()


def test_manifest_is_json_of_its_version(spark, tmp_path):
    store = make(spark, tmp_path)
    v = store.append(events(spark, [1]))
    assert json.loads((tmp_path / "store" / "manifest" / f"v{v:012d}.json").read_text())["version"] == v
    assert store.events(TraceQuery(time_from=0, time_to=9)).count() == 0 and store.segments(TraceQuery(time_from=0, time_to=9)) == []
    assert store.events().agg(F.max("lsn")).first()[0] == store.manifest()["segments"][0]["lsn"]
