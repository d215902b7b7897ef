"""Every query of the trace engine over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import evalkit
from spanloom.functions import ids, scalars
from spanloom.functions.tokenize import bigrams
from spanloom.operators import evals, fold, graph, nearest, search, views
from spanloom.operators.fold import TraceQuery
from spanloom.operators.textindex import TextIndex, hybrid
from spanloom.plans.oracle import ORACLE, QUERIES_, VALUES, WINDOW
from spanloom.sources import fixtures as fx
from spanloom.sources import otlp, wire
from spanloom.sources.files import scratch, written
from spanloom.sources.store import TraceStore
from spanloom.streaming import ingest

__all__ = ["ORACLE", "QUERIES"]

ORDER = ["src_row"]
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_EVENTS: dict[tuple, DataFrame] = {}


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a columnar table, ingested by the first query of a session that asks for them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _EVENTS:
        _EVENTS[key] = written(fx.span_events(spark, d).repartition("trace_id", "span_id"), "events")
    return _EVENTS[key]


def _spans(spark: SparkSession, d: str, **kw) -> DataFrame:
    return fold.spans(_events(spark, d), ORDER, **kw)


@query
def ingested_events(spark, d):
    """Events by type, of the table that the other queries read."""
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("events"))


def _flat(spans: DataFrame) -> DataFrame:
    return spans.select("trace_id", "span_id", *VALUES, F.array_join("logs", "|").alias("logs"), "event_count")


@query
def fold_spans(spark, d):
    return _flat(_spans(spark, d))


@query
def fold_dedup_retransmit(spark, d):
    ev = _events(spark, d)
    kept = fold.dedup(ev, ORDER, "global").agg(F.count("*").alias("kept"), F.countDistinct("trace_id", "span_id").alias("spans"))
    return ev.agg(F.count("*").alias("sent")).crossJoin(kept)


@query
def fold_logs_union(spark, d):
    return _flat(_spans(spark, d)).select("trace_id", "span_id", "logs", "event_count")


@query
def fold_with_patches(spark, d):
    return _spans(spark, d, patches=fx.patches(spark, d)).select("trace_id", "span_id", "status", "duration_ns", "eval_score", "eval_label")


@query
def fold_with_tombstones(spark, d):
    return _flat(_spans(spark, d, tombstones=fx.tombstones(spark, d), tombstone_keys=["src_row"]))


@query
def fold_time_window(spark, d):
    return _flat(_spans(spark, d, query=TraceQuery(time_from=WINDOW[0], time_to=WINDOW[1])))


@query
def fold_time_window_spans(spark, d):
    return _flat(_spans(spark, d, query=TraceQuery(time_from=WINDOW[0], time_to=WINDOW[1]), window_mode="spans"))


@query
def fold_tenant(spark, d):
    return _flat(_spans(spark, d, query=TraceQuery(tenant_id=1)))


@query
def fold_candidates(spark, d):
    keys = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'purchase'").selectExpr("event_id div 30 as trace_id", "(event_id % 30) div 3 as span_id")
    return _flat(_spans(spark, d, keys=keys))


@query
def merge_spans(spark, d):
    right = fold.fold(_events(spark, d).filter("event_type = 4"), ORDER).select("trace_id", "span_id", "status", "input_tokens")
    return fold.merge_spans(_spans(spark, d).select("trace_id", "span_id", "status", "input_tokens"), right)


@query
def list_traces(spark, d):
    return views.list_traces(_spans(spark, d))


@query
def list_traces_tenant(spark, d):
    return views.list_traces(_spans(spark, d, query=TraceQuery(tenant_id=1)))


@query
def list_sessions(spark, d):
    return views.list_sessions(_spans(spark, d))


@query
def console_sessions(spark, d):
    return views.console_sessions(_spans(spark, d))


@query
def sessions_page(spark, d):
    return views.sessions_page(_spans(spark, d), "agent", cursor=10, limit=20)


@query
def session_timeline(spark, d):
    return views.session_timeline(fx.turns(spark, d)).drop("agents", "eval_score")


@query
def session_totals(spark, d):
    return views.session_totals(views.session_timeline(fx.turns(spark, d)))


@query
def session_turns(spark, d):
    return views.session_turns(fx.turns(spark, d))


@query
def session_agents(spark, d):
    return views.session_timeline(_spans(spark, d)).select("session_id", "trace_id", F.array_join("agents", "|").alias("agents"))


@query
def cost_by_agent(spark, d):
    return views.cost_by_agent(_spans(spark, d))


@query
def trace_waterfall(spark, d):
    return views.waterfall(_spans(spark, d))


@query
def trace_summary(spark, d):
    return views.trace_summary(_spans(spark, d))


@query
def steps(spark, d):
    return views.steps(_spans(spark, d))


@query
def span_detail(spark, d):
    return views.span_detail(_spans(spark, d, query=TraceQuery(trace_id=3)), 3, 4)


@query
def trace_depth(spark, d):
    return graph.trace_depth(_spans(spark, d))


@query
def trace_tree(spark, d):
    return graph.trace_tree(_spans(spark, d)).withColumn("children", F.concat_ws(",", F.transform("children", lambda x: x.cast("string"))))


@query
def trace_dfs(spark, d):
    return graph.trace_dfs(_spans(spark, d))


@query
def agent_graph_nodes(spark, d):
    return graph.agent_graph_nodes(_spans(spark, d))


@query
def agent_graph_edges(spark, d):
    return graph.agent_graph_edges(_spans(spark, d))


def _chain(spark: SparkSession, d: str) -> DataFrame:
    """A trace for every thousand events, each span the child of the one before."""
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id div 1000 as trace_id", "event_id % 1000 as span_id", "case when event_id % 1000 > 0 then event_id % 1000 - 1 end as parent_span_id")


@query
def chain_dfs(spark, d):
    """Preorder of deep chains."""
    return graph.trace_dfs(_chain(spark, d))


@query
def chain_depth(spark, d):
    return graph.trace_depth(_chain(spark, d))


@query
def event_ids(spark, d):
    ev = fold.dedup(_events(spark, d), ORDER)
    return ev.select("ext_span_id", "seq", "event_type", ids.event_id(F.col("ext_span_id"), F.col("seq"), F.col("event_type")).alias("event_id"))


@query
def filter_attrs(spark, d):
    return views.filter_attrs(_spans(spark, d), _events(spark, d))


_INDEXES: dict[tuple, TextIndex] = {}


def _index(spark: SparkSession, d: str) -> TextIndex:
    """The stored index of the documents, built by the first query of a session that asks for it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex(spark, scratch(spark, "text")).add(fx.documents(spark, d), one_row_each=True)
    return _INDEXES[key]


@query
def bm25_index(spark, d):
    """Documents and tokens of a new index, made in two batches and compacted."""
    docs = fx.documents(spark, d)
    index = TextIndex(spark, scratch(spark, "text")).add(docs.filter("span_id < 5"), one_row_each=True).add(docs.filter("span_id >= 5"), one_row_each=True).compact()
    return index.lengths().agg(F.count("*").alias("n"), F.sum("doc_len").alias("total")).withColumns({"known_n": F.lit(index.n), "known_total": F.lit(index.total)})


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES_, "query_id int, query string")


@query
def bm25_terms(spark, d):
    return _index(spark, d).postings().groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query
def bm25_search(spark, d):
    return _index(spark, d).search(_asked(spark))


@query
def bm25_search_filtered(spark, d):
    return _index(spark, d).search(_asked(spark), 10, fx.documents(spark, d), search.SearchFilter(tenant_id=1, status=0))


@query
def bm25_search_overfetch(spark, d):
    found = _index(spark, d).search(_asked(spark), 50).drop("rank")
    return search.top(search.restrict(found, fx.documents(spark, d), search.SearchFilter(tenant_id=1)), 10, F.desc("score"))


@query
def bm25_similar(spark, d):
    """Every hundredth document as a query, whole, against all."""
    asked = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id % 100 = 0").selectExpr("doc_id as query_id", "text as query")
    return _index(spark, d).search(asked, 5)


@query
def contains_search(spark, d):
    return search.contains_search(fx.documents(spark, d), "License Apache")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The queries of vector search: every hundredth vector."""
    return fx.embeddings(spark, d).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query
def vector_l2(spark, d):
    return nearest.vector_batch(fx.embeddings(spark, d), _vectors(spark, d))


@query
def vector_cosine(spark, d):
    return nearest.vector_batch(fx.embeddings(spark, d), _vectors(spark, d), metric="cosine")


@query
def vector_ip(spark, d):
    return nearest.vector_batch(fx.embeddings(spark, d), _vectors(spark, d), metric="ip")


@query
def vector_batch(spark, d):
    """Every vector as a query."""
    e = fx.embeddings(spark, d)
    return nearest.vector_batch(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5)


@query
def vector_ann(spark, d):
    """Approximate: the nearest lists of an inverted file over all vectors."""
    index = nearest.VectorIndex.build(fx.embeddings(spark, d), scratch(spark, "vectors"))
    return index.search(_vectors(spark, d))


@query
def vector_filtered(spark, d):
    return nearest.vector_batch(fx.embeddings(spark, d).filter("label = 3"), _vectors(spark, d))


@query
def vector_postfilter(spark, d):
    """The filter after the pool, which loses hits where the filter is selective."""
    e = fx.embeddings(spark, d)
    best = nearest.vector_batch(e, _vectors(spark, d), 32).drop("rank").join(e.select("trace_id", "span_id", "label"), ["trace_id", "span_id"])
    return search.top(best.filter("label = 3").drop("label"), 10, F.asc("distance"))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector with one of the texts in turn."""
    n = F.pmod(F.call_function("div", F.col("query_id"), F.lit(100)), F.lit(len(QUERIES_))) + 1
    return _vectors(spark, d).withColumn("n", n).join(_asked(spark).select(F.col("query_id").alias("n"), "query"), "n").drop("n")


@query
def rrf_fuse(spark, d):
    asked = _both(spark, d)
    return search.rrf([_index(spark, d).search(asked.select("query_id", "query")), nearest.vector_batch(fx.embeddings(spark, d), asked)])


@query
def hybrid_search(spark, d):
    return hybrid(_index(spark, d), fx.embeddings(spark, d), _both(spark, d))


@query
def hybrid_search_filtered(spark, d):
    return hybrid(_index(spark, d), fx.embeddings(spark, d), _both(spark, d), attrs=fx.documents(spark, d), wanted=search.SearchFilter(tenant_id=2))


@query
def search_joined(spark, d):
    found = search.join_spans(_index(spark, d).search(_asked(spark)), fx.documents(spark, d))
    return found.select("query_id", "rank", "score", "agent_name", "status", "trace_id", "span_id")


def _searchable(spark: SparkSession, d: str) -> TraceStore:
    """Events in three segments, indexed one after the other, with a vector for some spans."""
    store = TraceStore(spark, scratch(spark, "store"))
    ev = _events(spark, d)
    for n in range(3):
        store.append(ev.filter(F.pmod("src_row", F.lit(3)) == n), order=ORDER)
        store.index_text()
    store.index_embedding(fx.embeddings(spark, d).select("trace_id", "span_id", "embedding"))
    return store


EVENT_QUERIES = [(1, "ask purchase"), (2, "done error agent3"), (3, "tool1 model"), (4, "signup signup")]


@query
def event_search(spark, d):
    found = _searchable(spark, d).search(spark.createDataFrame(EVENT_QUERIES, "query_id int, query string"))
    return found.select("query_id", "rank", "score", "trace_id", "span_id", "agent_name", "event_count")


@query
def event_search_filtered(spark, d):
    wanted = search.SearchFilter(tenant_id=1, time_from=WINDOW[0], time_to=WINDOW[1])
    found = _searchable(spark, d).search(spark.createDataFrame(EVENT_QUERIES, "query_id int, query string"), wanted=wanted)
    return found.select("query_id", "rank", "score", "trace_id", "span_id")


@query
def event_search_similar(spark, d):
    """Vector search over a store's spans; vectors of spans that it doesn't show are no hits."""
    found = _searchable(spark, d).search(_vectors(spark, d), wanted=search.SearchFilter(status=0))
    return found.select("query_id", "rank", "distance", "trace_id", "span_id")


@query
def event_search_hybrid(spark, d):
    asked = _vectors(spark, d).join(spark.createDataFrame([(1, EVENT_QUERIES[0][1])], "n int, query string"))
    found = _searchable(spark, d).search(asked.select("query_id", "query", "vector"), wanted=search.SearchFilter(tenant_id=2))
    return found.select("query_id", "rank", "score", "trace_id", "span_id")


BAD = ["error", "signup"]


@query
def eval_keyword(spark, d):
    return evals.score_spans(_spans(spark, d), evals.keyword_scorer(BAD))


@query
def eval_summary(spark, d):
    return evals.eval_summary(fx.scored(spark, d))


@query
def eval_summary_keyword(spark, d):
    return evals.eval_summary(evals.score_spans(_spans(spark, d), evals.keyword_scorer(BAD)))


@query
def eval_dataset_stricter(spark, d):
    examples = evals.collect_examples("fine", _spans(spark, d), "status = 0")
    return evals.eval_dataset(examples, "fine", evals.keyword_scorer(["error", "click"]))


@query
def eval_writeback(spark, d):
    spans = _spans(spark, d)
    homes = spans.select("trace_id", "span_id", F.lit(0).cast("bigint").alias("segment_id"))
    patches = evals.writeback(spans, evals.keyword_scorer(BAD), homes, 1)
    out = fold.apply_patches(spans, patches).filter("eval_score is not null")
    return out.select("trace_id", "span_id", "eval_score", "eval_label", F.coalesce("status", F.lit(0)).alias("status"))


@query
def dataset_collect(spark, d):
    spans = _spans(spark, d)
    failed = evals.collect_examples("failed", spans, "status = 1")
    again = evals.collect_examples("failed", spans, "status = 1", existing=failed)
    return evals.list_datasets(failed.union(again).union(evals.collect_examples("long", spans, F.col("duration_ns") > 50_000_000)))


@query
def session_eval(spark, d):
    return evals.score_sessions(views.session_timeline(fx.turns(spark, d)), ["avec"])


def _stored(spark: SparkSession, d: str, parts: int = 3) -> TraceStore:
    """A store with the events in ``parts`` segments."""
    store = TraceStore(spark, scratch(spark, "store"))
    ev = _events(spark, d)
    for n in range(parts):
        store.append(ev.filter(F.pmod("trace_id", F.lit(parts)) == n), order=ORDER)
    return store


@query
def stored_traces(spark, d):
    return views.list_traces(_stored(spark, d).spans())


@query
def compaction_equivalence(spark, d):
    store = _stored(spark, d)
    places = store.events().filter("trace_id * 30 + span_id * 3 + case event_type when 1 then 0 when 4 then 1 else 2 end >= 0")
    source = (F.col("trace_id") * 30 + F.col("span_id") * 3 + F.col("seq") - 1) % 13 == 0
    store.delete(places.filter(source).select("segment_id", "row_idx"))
    store.compact()
    return views.list_traces(store.spans())


@query
def store_window(spark, d):
    """Segments outside the window are not read; the rest is asked of rows."""
    store = TraceStore(spark, scratch(spark, "store"))
    ev = _events(spark, d)
    for low, high in ((0, WINDOW[0]), (WINDOW[0], WINDOW[1] + 1), (WINDOW[1] + 1, 1 << 62)):
        store.append(ev.filter((F.col("ts") >= low) & (F.col("ts") < high)), order=ORDER)
    asked = TraceQuery(time_from=WINDOW[0], time_to=WINDOW[1])
    return _flat(store.spans(asked)).withColumn("segments", F.lit(len(store.segments(asked))))


@query
def store_history(spark, d):
    """A pinned version and the last one, after deletion, late patches, flush, compaction, vacuum and a restored backup."""
    store = _stored(spark, d)
    pinned = store.manifest()["version"]
    store.delete(store.events().filter("(trace_id * 30 + span_id * 3 + seq - 1) % 13 = 0").select("segment_id", "row_idx"))
    store.upgrade(fx.patches(spark, d).drop("segment_id", "patch_seq").groupBy("trace_id", "span_id").agg(F.max("eval_score").cast("int").alias("eval_score")))
    store.flush()
    store.compact()
    store.vacuum(pinned=[pinned])
    copy = scratch(spark, "backup")
    store.backup(copy)
    last = TraceStore(spark, copy).spans()
    total = lambda spans, name: spans.groupBy("trace_id").agg(F.lit(name).alias("version"), F.count("*").alias("spans"), F.sum("event_count").alias("events"), F.sum("eval_score").cast("bigint").alias("eval_score"))
    return total(store.spans(version=pinned), "pinned").union(total(last, "last"))


@query
def store_replay(spark, d):
    """The rows that came after the first append."""
    store = _stored(spark, d)
    first = store.manifest(1)["segments"][0]["lsn"]
    return store.replay(first).groupBy("lsn").agg(F.count("*").alias("events")).withColumn("lsn", F.col("lsn") - first)


@query
def eval_store(spark, d):
    """Scores written back through a store, and read as its spans' values."""
    store = _stored(spark, d)
    store.evaluate(evals.keyword_scorer(BAD))
    return store.spans().filter("eval_score is not null").select("trace_id", "span_id", "eval_score", "eval_label")


@query
def dataset_store(spark, d):
    """Datasets kept by a store: collected twice, scored by a stricter scorer."""
    store = _stored(spark, d)
    for _ in range(2):
        store.collect("fine", "status = 0")
    return evals.eval_dataset(store.datasets(), "fine", evals.keyword_scorer(["error", "click"]))


@query
def streamed_sessions(spark, d):
    """Running session totals, kept as state of a stream over event files; the view after the last batch."""
    folder = scratch(spark, "sessions")
    _events(spark, d).drop("src_row").repartition(4).write.parquet(f"{folder}/in")
    totals = ingest.session_totals(ingest.event_stream(spark, f"{folder}/in", 1), "1000 days")
    view = ingest.SessionView(spark, f"{folder}/view")
    with ingest.state_on_disk(spark):
        started = totals.writeStream.outputMode("update").foreachBatch(view.merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return view.read()


@query
def wire_tenant(spark, d):
    """The caller's tenant instead of what the events say."""
    ev = wire.parse_wire(wire.to_wire(_events(spark, d).drop("src_row")), tenant_id=77, override_tenant=True)
    return ev.groupBy("tenant_id").agg(F.count("*").alias("events"))


@query
def tokens_cjk(spark, d):
    """Han runs in pairs, others in lower case, side by side."""
    text = F.concat(F.lit("反洗钱"), F.col("source"), F.lit(" 规则ABC卡9"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(bigrams(text), "|").alias("tokens"))


@query
def scalars_of_events(spark, d):
    ev = fx.span_events(spark, d).dropDuplicates(["src_row"])
    return ev.select("src_row", scalars.rfc3339(F.col("ts")).alias("at"), ids.event_type_name(F.col("event_type")).alias("type"), ids.event_type_tag(ids.event_type_name(F.col("event_type")), F.col("event_type")).alias("tag"), ids.derive_seq(F.col("ts"), F.encode("ext_span_id", "utf-8")).alias("derived"), scalars.clamp_score(F.col("src_row")).alias("clamped"), F.crc32(F.encode("ext_span_id", "utf-8")).alias("crc"))


@query
def harness(spark, d):
    """Generated scenarios, scored through a store: what was made to fail fails."""
    return evalkit.run_harness(TraceStore(spark, scratch(spark, "store")), 200)


@query
def session_harness(spark, d):
    return evalkit.run_session_harness(TraceStore(spark, scratch(spark, "store")), 500)


@query
def streamed_traces(spark, d):
    """The events as wire JSON files, through a stream into a store."""
    folder = scratch(spark, "stream")
    wire.to_wire(_events(spark, d).drop("src_row")).write.text(f"{folder}/in")
    store = TraceStore(spark, f"{folder}/store")
    ingest.run(ingest.wire_stream(spark, f"{folder}/in"), store, f"{folder}/checkpoint")
    return views.list_traces(store.spans())


@query
def wire_roundtrip(spark, d):
    ev = wire.parse_wire(wire.to_wire(_events(spark, d).drop("src_row")))
    return ev.select("trace_id", "span_id", "seq", "event_type", "ext_span_id", "status", "duration_ns", "input_tokens", "model", "input_text", F.array_join("logs", "|").alias("logs"))


@query
def otlp_parse(spark, d):
    """Spans of the events table as OTLP bodies, parsed and folded."""
    ev = fx.span_events(spark, d).filter("event_type = 1").dropDuplicates(["ext_span_id"])
    attr = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    span = F.struct(F.lpad(F.hex("trace_id"), 32, "0").alias("traceId"), F.lpad(F.hex(F.col("trace_id") * 10 + F.col("span_id")), 16, "0").alias("spanId"), F.coalesce("input_text", F.lit("")).alias("name"), F.col("ts").cast("string").alias("startTimeUnixNano"), (F.col("ts") + 5000).cast("string").alias("endTimeUnixNano"), F.struct(F.lit(2).alias("code")).alias("status"), F.array(attr("llm.model_name", F.col("model")), attr("session.id", F.col("session_id"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return _flat(fold.spans(otlp.parse_otlp(ev.select(body.alias("body"))), ["ts"]))


@query
def otlp_forms(spark, d):
    """Spans whose texts stand in span events or messages, with every status, numbers as text and whole doubles, names in snake case."""
    ev = fx.span_events(spark, d).filter("event_type = 1").dropDuplicates(["ext_span_id"])
    s = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue"), F.lit(None).cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value"))
    i = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), v.cast("string").alias("intValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value"))
    f = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), F.lit(None).cast("string").alias("intValue"), v.cast("double").alias("doubleValue")).alias("value"))
    messages = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("first "), "model").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("second").alias("content"))))
    attributes = F.array(s("gen_ai.response.model", F.col("model")), s("llm.model_name", F.lit("not this one")), i("gen_ai.usage.prompt_tokens", F.col("span_id")), f("llm.token_count.completion", F.col("trace_id")), s("agent.name", F.col("agent_name")), s("tool.name", F.col("tool_name")), s("input.value", messages), s("session.id", F.concat(F.lit("s"), F.pmod("trace_id", F.lit(5)).cast("string"))))
    said = F.array(F.struct(F.lit("gen_ai.choice").alias("name"), F.array(s("content", F.concat(F.lit("said "), "ext_span_id"))).alias("attributes")), F.struct(F.lit("gen_ai.user.message").alias("name"), F.array(s("content", F.lit("not used"))).alias("attributes")))
    status = F.struct(F.pmod("span_id", F.lit(3)).alias("code"))
    span = F.struct(F.lpad(F.hex("trace_id"), 32, "0").alias("trace_id"), F.lpad(F.hex(F.col("trace_id") * 10 + F.col("span_id") + 1), 16, "0").alias("span_id"), F.lpad(F.hex(F.col("trace_id") * 10 + 1), 16, "0").alias("parent_span_id"), F.lit("step").alias("name"), F.col("ts").cast("string").alias("start_time_unix_nano"), (F.col("ts") - 10 + F.col("span_id") * 5).cast("string").alias("end_time_unix_nano"), status.alias("status"), attributes.alias("attributes"), said.alias("events"))
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scope_spans"))).alias("resource_spans")))
    return _flat(fold.spans(otlp.parse_otlp(ev.select(body.alias("body")), tenant_id=9), ["ts", "seq"]))


ORACLE["otlp_parse"] = ORACLE["fold_spans"].split("\nSELECT")[0] + "\nSELECT trace_id, trace_id * 10 + span_id AS span_id, 1 AS status, 5000::BIGINT AS duration_ns, NULL::BIGINT AS parent_span_id, NULL::BIGINT AS input_tokens, NULL::BIGINT AS output_tokens, session_id, NULL::BIGINT AS tenant_id, NULL::VARCHAR AS agent_name, NULL::VARCHAR AS tool_name, model, NULL::VARCHAR AS input_text, NULL::VARCHAR AS output_text, input_text AS logs, 2 AS event_count FROM once WHERE event_type = 1"
