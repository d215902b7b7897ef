"""DuckDB SQL with the rows of every query in the catalog."""

from __future__ import annotations

EVENTS = """base AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) * 1000 AS ts_ns, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
once AS (SELECT event_id // 30 AS trace_id, (event_id % 30) // 3 AS span_id, ts_ns AS ts, event_id % 3 + 1 AS seq, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 2 END AS event_type,
 (event_id // 30)::VARCHAR || '-' || ((event_id % 30) // 3)::VARCHAR AS ext_span_id, CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'view' THEN NULL ELSE 0 END AS status,
 CASE WHEN event_id % 3 = 2 THEN CAST(round(value * 100) AS BIGINT) * 10000 END AS duration_ns, CASE WHEN (event_id % 30) // 3 > 0 THEN ((event_id % 30) // 3 - 1) // 2 END AS parent_span_id,
 CASE WHEN event_id % 3 = 0 THEN k END AS input_tokens, CASE WHEN event_id % 3 = 2 THEN k * 2 END AS output_tokens, (event_id // 30) % 50 AS session_id, (event_id // 30) % 3 AS tenant_id,
 CASE WHEN (event_id % 30) // 3 % 3 < 2 THEN 'agent' || (user_id % 5)::VARCHAR END AS agent_name, CASE WHEN (event_id % 30) // 3 % 3 = 2 THEN 'tool' || (user_id % 4)::VARCHAR END AS tool_name,
 CASE WHEN k % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model, CASE WHEN event_id % 3 = 0 THEN 'ask ' || event_type || ' ' || k::VARCHAR END AS input_text,
 CASE WHEN event_id % 3 = 2 AND event_type <> 'view' THEN 'done ' || event_type END AS output_text, event_type AS log_line, event_id AS src_row FROM base),
ev AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE src_row % 7 = 0)"""

VALUES = ["status", "duration_ns", "parent_span_id", "input_tokens", "output_tokens", "session_id", "tenant_id", "agent_name", "tool_name", "model", "input_text", "output_text"]


def folded(where: str = "true", source: str = "ev") -> str:
    """CTEs up to ``sp``: the spans of the events that meet a condition."""
    last = ", ".join(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in VALUES)
    return f"""{EVENTS},
seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ext_span_id, seq, event_type ORDER BY src_row) AS rn FROM {source} WHERE {where}) WHERE rn = 1),
lines AS (SELECT trace_id, span_id, string_agg(log_line, '|' ORDER BY first_seq) AS logs FROM (SELECT trace_id, span_id, log_line, min(seq) AS first_seq FROM seen GROUP BY ALL) GROUP BY ALL),
sp AS (SELECT trace_id, span_id, {last}, any_value(logs) AS logs, count(*) AS event_count FROM seen JOIN lines USING (trace_id, span_id) GROUP BY trace_id, span_id)"""


def q(select: str, ctes: str = "", **kw) -> str:
    return f"WITH RECURSIVE {ctes or folded(**kw)}\n{select}"


SPANS = f"SELECT trace_id, span_id, {', '.join(VALUES)}, logs, event_count FROM sp"
TRACES = "SELECT trace_id, count(*) AS span_count, coalesce(sum(duration_ns), 0)::BIGINT AS total_duration_ns, coalesce(max(duration_ns), 0) AS max_duration_ns, count(*) FILTER (coalesce(status, 0) <> 0) AS error_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM sp {where} GROUP BY trace_id"
CONSOLE = "cs AS (SELECT session_id, coalesce(arg_min(agent_name, trace_id * 1000 + span_id) FILTER (agent_name IS NOT NULL), '会话 ' || session_id::VARCHAR) AS title, count(DISTINCT trace_id) AS turn_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, count(*) FILTER (coalesce(status, 0) <> 0) > 0 AS has_error, min(trace_id) AS first_trace_id FROM sp WHERE session_id IS NOT NULL GROUP BY session_id)"
COST = "round({i} * 8e-7 + {o} * 4e-6, 3)"
WATERFALL = """wf AS (SELECT trace_id, span_id, parent_span_id, CASE WHEN agent_name IS NOT NULL THEN 'agent' WHEN tool_name IS NOT NULL THEN 'tool' WHEN model IS NOT NULL THEN 'llm' ELSE 'other' END AS kind, coalesce(agent_name, tool_name, model, 'span ' || span_id::VARCHAR) AS name,
 CASE WHEN coalesce(status, 0) <> 0 THEN 'error' ELSE 'ok' END AS status_label, coalesce(sum(duration_ns) OVER (PARTITION BY trace_id ORDER BY span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ns, coalesce(duration_ns, 0) AS duration_ns, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, input_text, output_text FROM sp)"""
TREE = "up AS (SELECT s.trace_id, s.span_id, CASE WHEN p.span_id IS NOT NULL THEN s.parent_span_id END AS up, s.parent_span_id FROM sp s LEFT JOIN sp p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id)"
ACTORS = "ac AS (SELECT *, coalesce(agent_name, tool_name, 'span:' || span_id::VARCHAR) AS actor FROM sp)"
TURNS = """tu AS (SELECT conv_id AS session_id, conv_id * 1000 + CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS trace_id, turn AS span_id, CASE WHEN role = 'user' THEN text END AS input_text, CASE WHEN role = 'assistant' THEN text END AS output_text, length(text) AS duration_ns FROM conversations),
tl AS (SELECT session_id, trace_id, arg_min(input_text, span_id) FILTER (input_text IS NOT NULL) AS user_input, arg_max(output_text, span_id) FILTER (output_text IS NOT NULL) AS agent_output, count(*) AS span_count, 0::BIGINT AS error_count, sum(duration_ns)::BIGINT AS duration_ns, count(*) AS input_tokens, 2 * count(*) AS output_tokens, row_number() OVER (PARTITION BY session_id ORDER BY trace_id) - 1 AS turn_index FROM tu GROUP BY session_id, trace_id)"""
DOCS = "dd AS (SELECT doc_id // 10 AS trace_id, doc_id % 10 AS span_id, text, source AS agent_name, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS status, doc_id % 3 AS tenant_id FROM documents)"
POSTINGS = rf"""{DOCS},
tk AS (SELECT trace_id, span_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS token FROM dd),
ix AS (SELECT token, trace_id, span_id, count(*) AS tf FROM tk GROUP BY ALL),
st AS (SELECT trace_id, span_id, sum(tf) AS doc_len FROM ix GROUP BY ALL),
co AS (SELECT count(*) AS n, sum(doc_len) / count(*) AS avgdl FROM st)"""
QUERIES_ = [(1, "the trash idiot"), (2, "licensed under the apache license"), (3, "dans les eaux"), (4, "qqqqq")]
ASKED = rf"""qs(query_id, query) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in QUERIES_)}),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS token FROM qs),
df AS (SELECT token, count(*) AS df FROM ix WHERE token IN (SELECT token FROM qt) GROUP BY token),
sc AS (SELECT query_id, trace_id, span_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * doc_len / avgdl)))), 6) AS score FROM qt JOIN ix USING (token) JOIN df USING (token) JOIN st USING (trace_id, span_id), co GROUP BY ALL)"""


def ranked(source: str, by: str, k: int, where: str = "true") -> str:
    return f"SELECT query_id, trace_id, span_id, {by.split()[0]}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}, trace_id, span_id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


def vectors(metric: str, name: str = "vd", queries: str = "vec_id % 100 = 0") -> str:
    a, b = ("list_transform(e.embedding, lambda x: x::DOUBLE)", "list_transform(v.embedding, lambda x: x::DOUBLE)")
    if metric == "cosine":
        a, b = (f"list_transform({x}, lambda y: y / sqrt(list_dot_product({x}, {x})))" for x in (a, b))
    d = f"-list_dot_product({a}, {b})" if metric == "ip" else f"list_distance({a}, {b})"
    return f"{name} AS (SELECT v.vec_id AS query_id, e.vec_id // 10 AS trace_id, e.vec_id % 10 AS span_id, round({d}, 6) AS distance, e.label FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE {queries}) v)"


PATCHED = """pm AS (SELECT event_id // 30 AS trace_id, (event_id % 30) // 3 AS span_id, arg_max(CASE WHEN event_type = 'purchase' THEN 2 END, event_id) FILTER (event_type = 'purchase') AS p_status, arg_max(CAST(round(value * 100) AS BIGINT) % 1001, event_id) AS eval_score, arg_max('lbl-' || event_type, event_id) AS eval_label FROM events WHERE event_id % 11 = 0 GROUP BY ALL)"""
SUMMARY = "SELECT {name} AS agent_name, count(*) AS scored, count(*) FILTER (eval_score >= 600) AS passed, CASE WHEN count(*) > 0 THEN sum(eval_score) // count(*) ELSE 0 END::BIGINT AS avg_score, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (eval_score >= 600) / count(*), 6) ELSE 0 END AS pass_rate FROM sc {group}"


def summary(scored: str) -> str:
    return f"{scored}\n{SUMMARY.format(name='NULL::VARCHAR', group='')} UNION ALL {SUMMARY.format(name='agent_name', group='WHERE agent_name IS NOT NULL GROUP BY agent_name')}"


KEYWORDS = "sc AS (SELECT trace_id, span_id, agent_name, CASE WHEN contains(output_text, 'error') OR contains(output_text, 'signup') THEN 0 ELSE 1000 END AS eval_score, CASE WHEN contains(output_text, 'error') OR contains(output_text, 'signup') THEN '未通过' ELSE '通过' END AS eval_label FROM sp WHERE output_text IS NOT NULL)"
DEPTH = "ch AS (SELECT trace_id, span_id, parent_span_id AS above, CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END AS depth FROM sp UNION ALL SELECT c.trace_id, c.span_id, s.parent_span_id, c.depth + 1 FROM ch c JOIN sp s ON s.trace_id = c.trace_id AND s.span_id = c.above AND s.parent_span_id IS NOT NULL WHERE c.depth < 65)"
PATHS = f"{TREE}, pa AS (SELECT trace_id, span_id, [span_id] AS path FROM up WHERE up IS NULL UNION ALL SELECT u.trace_id, u.span_id, list_append(p.path, u.span_id) FROM pa p JOIN up u ON u.trace_id = p.trace_id AND u.up = p.span_id)"
TOMBS = "kept AS (SELECT * FROM ev WHERE src_row % 13 <> 0)"
#: The window of the time queries, in ns since 1970: 2024-01-01 06:00 to 2024-01-05.
WINDOW = (1_704_088_800_000_000_000, 1_704_412_800_000_000_000)
IN_WINDOW = f"ts BETWEEN {WINDOW[0]} AND {WINDOW[1]}"
RRF = f"rk AS ({ranked('wx', 'score DESC', 10)}), rv AS ({ranked('vd', 'distance', 10)}), fu AS (SELECT query_id, trace_id, span_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, trace_id, span_id, rank FROM rk UNION ALL SELECT query_id, trace_id, span_id, rank FROM rv) GROUP BY ALL)"
#: Every hundredth vector asks one of the texts in turn.
TEXTS = f"tx AS (SELECT vec_id AS asked, vec_id // 100 % {len(QUERIES_)} + 1 AS n FROM embeddings WHERE vec_id % 100 = 0)"
ONE = f"{TEXTS}, wx AS (SELECT asked AS query_id, trace_id, span_id, score FROM sc JOIN tx ON sc.query_id = n)"
EVENT_TOKENS = r"""tk AS (SELECT trace_id, span_id, unnest(regexp_extract_all(lower(concat_ws(' ', input_text, output_text, agent_name, tool_name, model, log_line)), '[\p{L}\p{N}]+')) AS token FROM once),
ix AS (SELECT token, trace_id, span_id, count(*) AS tf FROM tk GROUP BY ALL),
st AS (SELECT trace_id, span_id, sum(tf) AS doc_len FROM ix GROUP BY ALL),
co AS (SELECT count(*) AS n, sum(doc_len) / count(*) AS avgdl FROM st)"""
EVENT_QUERIES = [(1, "ask purchase"), (2, "done error agent3"), (3, "tool1 model"), (4, "signup signup")]
TIMES = "fa AS (SELECT trace_id, span_id, min(ts) AS min_ts, max(ts) AS max_ts FROM ev GROUP BY ALL)"
#: FNV-1a of a list of bytes, as the signed number of the same bits.
FNV = "(CASE WHEN {h} >= 9223372036854775808 THEN ({h}::HUGEINT - 18446744073709551616)::BIGINT ELSE {h}::BIGINT END)"


def fnv(octets: str) -> str:
    return f"list_reduce(list_prepend(14695981039346656037::UBIGINT, {octets}), lambda h, b: ((xor(h, b)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT)"


def le8(x: str) -> str:
    return f"list_transform(range(8), lambda i: (({x} >> (8 * i)::INT) & 255)::UBIGINT)"


ASCII = "list_transform(string_split(ext_span_id, ''), lambda c: ascii(c)::UBIGINT)"


def asked(queries: list[tuple[int, str]]) -> str:
    return ASKED.split(",\nqt AS", 1)[0].split("(VALUES")[0] + "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in queries) + "),\nqt AS" + ASKED.split(",\nqt AS", 1)[1]

ORACLE = {
    "fold_spans": q(SPANS),
    "fold_dedup_retransmit": q("SELECT (SELECT count(*) FROM ev) AS sent, count(*) AS kept, count(DISTINCT trace_id * 1000 + span_id) AS spans FROM seen"),
    "fold_logs_union": q("SELECT trace_id, span_id, logs, event_count FROM sp"),
    "fold_with_patches": q("SELECT trace_id, span_id, coalesce(p_status, status) AS status, duration_ns, m.eval_score, m.eval_label FROM sp LEFT JOIN pm m USING (trace_id, span_id)", f"{folded()}, {PATCHED}"),
    "fold_with_tombstones": q(SPANS, folded(source="kept").replace("ev AS (SELECT * FROM once", "ev AS (SELECT * FROM once", 1).replace("seen AS", f"{TOMBS},\nseen AS", 1)),
    "fold_time_window": q(SPANS, where=IN_WINDOW),
    "fold_time_window_spans": q(SPANS, folded(where=f"(trace_id, span_id) IN (SELECT (trace_id, span_id) FROM ev WHERE {IN_WINDOW})")),
    "fold_tenant": q(f"{SPANS} WHERE tenant_id = 1"),
    "fold_candidates": q(SPANS, where="trace_id * 1000 + span_id IN (SELECT DISTINCT (event_id // 30) * 1000 + (event_id % 30) // 3 FROM events WHERE event_type = 'purchase')"),
    "merge_spans": q("SELECT trace_id, span_id, coalesce(b.status, a.status) AS status, coalesce(b.input_tokens, a.input_tokens) AS input_tokens FROM sp a LEFT JOIN (SELECT trace_id, span_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(input_tokens, seq) FILTER (input_tokens IS NOT NULL) AS input_tokens FROM once WHERE event_type = 4 GROUP BY ALL) b USING (trace_id, span_id)"),
    "list_traces": q(TRACES.format(where="")),
    "list_traces_tenant": q(TRACES.format(where="WHERE tenant_id = 1")),
    "list_sessions": q("SELECT session_id, count(DISTINCT trace_id) AS trace_count, count(*) AS span_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM sp WHERE session_id IS NOT NULL GROUP BY session_id"),
    "console_sessions": q("SELECT * FROM cs", f"{folded()}, {CONSOLE}"),
    "sessions_page": q(f"SELECT * EXCLUDE (rn), {COST.format(i='input_tokens', o='output_tokens')} AS cost, CASE WHEN 30 < total THEN 30 END::BIGINT AS next_cursor FROM (SELECT *, row_number() OVER (ORDER BY session_id DESC) AS rn, count(*) OVER () AS total FROM cs WHERE contains(title, 'agent') OR contains(session_id::VARCHAR, 'agent')) WHERE rn > 10 AND rn <= 30", f"{folded()}, {CONSOLE}"),
    "session_timeline": q("SELECT session_id, trace_id, turn_index, user_input, agent_output, span_count, error_count, duration_ns, input_tokens, output_tokens FROM tl", TURNS),
    "session_totals": q("SELECT session_id, count(*) AS turn_count, sum(span_count)::BIGINT AS span_count, sum(error_count)::BIGINT AS error_count, sum(duration_ns)::BIGINT AS duration_ns, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM tl GROUP BY session_id", TURNS),
    "session_turns": q(f"SELECT session_id, turn_index, trace_id, CASE WHEN length(n) > 40 THEN left(n, 40) || '…' ELSE n END AS name, user_input, agent_output, span_count, error_count, duration_ns // 1000000 AS dur_ms, 'ok' AS status, input_tokens, output_tokens, {COST.format(i='input_tokens', o='output_tokens')} AS cost FROM (SELECT *, coalesce(user_input, '第' || (turn_index + 1)::VARCHAR || '轮') AS n FROM tl)", TURNS),
    "session_agents": q("SELECT session_id, trace_id, coalesce(string_agg(DISTINCT agent_name, '|' ORDER BY agent_name), '') AS agents FROM sp WHERE session_id IS NOT NULL GROUP BY ALL"),
    "cost_by_agent": q("SELECT agent_name, count(*) AS span_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM sp WHERE agent_name IS NOT NULL GROUP BY agent_name"),
    "trace_waterfall": q("SELECT * FROM wf", f"{folded()}, {WATERFALL}"),
    "trace_summary": q("SELECT trace_id, arg_min(name, span_id) AS name, sum(duration_ns)::BIGINT // 1000000 AS duration_ms, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, CASE WHEN count(*) FILTER (status_label = 'error') > 0 THEN 'error' ELSE 'ok' END AS status_label FROM wf GROUP BY trace_id", f"{folded()}, {WATERFALL}"),
    "steps": q("SELECT trace_id, span_id, kind, name, status_label, start_ns // 1000000 AS start_ms, duration_ns // 1000000 AS dur_ms, input_text, output_text FROM wf", f"{folded()}, {WATERFALL}"),
    "span_detail": q("SELECT trace_id, span_id, input_text, output_text, logs, model, NULL::INT AS eval_score, NULL::VARCHAR AS eval_label FROM sp WHERE trace_id = 3 AND span_id = 4"),
    "trace_depth": q("SELECT trace_id, span_id, max(depth)::INT AS depth FROM ch GROUP BY ALL", f"{folded()}, {DEPTH}"),
    "trace_tree": q("SELECT u.trace_id, u.span_id, u.parent_span_id, u.up IS NULL AS is_root, coalesce(k.children, '') AS children FROM up u LEFT JOIN (SELECT trace_id, parent_span_id AS span_id, string_agg(span_id::VARCHAR, ',' ORDER BY span_id) AS children FROM sp WHERE parent_span_id IS NOT NULL GROUP BY ALL) k USING (trace_id, span_id)", f"{folded()}, {TREE}"),
    "trace_dfs": q("SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS visit FROM pa", f"{folded()}, {PATHS}"),
    "agent_graph_nodes": q("SELECT trace_id, actor, arg_min(CASE WHEN agent_name IS NOT NULL THEN 'agent' WHEN tool_name IS NOT NULL THEN 'tool' ELSE 'span' END, span_id) AS kind, count(*) AS span_count, sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0))::BIGINT AS total_tokens FROM ac GROUP BY ALL", f"{folded()}, {ACTORS}"),
    "agent_graph_edges": q("SELECT c.trace_id, p.actor AS caller, c.actor AS callee, count(*) AS calls FROM ac c JOIN ac p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.actor <> c.actor GROUP BY ALL", f"{folded()}, {ACTORS}"),
    "filter_attrs": q("SELECT trace_id, span_id, status, agent_name, tenant_id, min_ts, max_ts FROM sp JOIN (SELECT trace_id, span_id, min(ts) AS min_ts, max(ts) AS max_ts FROM ev GROUP BY ALL) USING (trace_id, span_id)"),
    "bm25_terms": q("SELECT token, count(*) AS df, sum(tf)::BIGINT AS tf FROM ix GROUP BY token", POSTINGS),
    "bm25_search": q(ranked("sc", "score DESC", 10), f"{POSTINGS}, {ASKED}"),
    "bm25_search_filtered": q(ranked("(SELECT sc.* FROM sc JOIN dd USING (trace_id, span_id) WHERE tenant_id = 1 AND status = 0)", "score DESC", 10), f"{POSTINGS}, {ASKED}"),
    "bm25_search_overfetch": q(ranked(f"(SELECT s.query_id, s.trace_id, s.span_id, s.score FROM ({ranked('sc', 'score DESC', 50)}) s JOIN dd USING (trace_id, span_id) WHERE tenant_id = 1)", "score DESC", 10), f"{POSTINGS}, {ASKED}"),
    "contains_search": q(ranked("(SELECT 0 AS query_id, trace_id, span_id, (CASE WHEN contains(text, 'License') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'Apache') THEN 1 ELSE 0 END)::DOUBLE AS score FROM dd)", "score DESC", 10, "score > 0"), DOCS),
    "vector_l2": q(ranked("vd", "distance", 10), vectors("l2")),
    "vector_cosine": q(ranked("vd", "distance", 10), vectors("cosine")),
    "vector_ip": q(ranked("vd", "distance", 10), vectors("ip")),
    "vector_batch": q("SELECT a.query_id, a.trace_id, a.span_id, a.distance, a.rank FROM (SELECT v.vec_id AS query_id, e.vec_id // 10 AS trace_id, e.vec_id % 10 AS span_id, round(list_distance(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)), 6) AS distance, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_distance(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)), 6), e.vec_id) AS rank FROM embeddings e, embeddings v) a WHERE rank <= 5", "one AS (SELECT 1)"),
    "vector_filtered": q(ranked("vd", "distance", 10, "label = 3"), vectors("l2")),
    "vector_postfilter": q(ranked(f"(SELECT p.*, e.label FROM ({ranked('vd', 'distance', 32)}) p JOIN embeddings e ON e.vec_id = p.trace_id * 10 + p.span_id)".replace("p.*", "p.query_id, p.trace_id, p.span_id, p.distance"), "distance", 10, "label = 3"), vectors("l2")),
    "rrf_fuse": q(ranked("fu", "score DESC", 10), f"{POSTINGS}, {ASKED}, {ONE}, {vectors('l2')}, {RRF}"),
    "hybrid_search": q(ranked("fu", "score DESC", 10), f"{POSTINGS}, {ASKED}, {ONE}, {vectors('l2')}, {RRF}"),
    "hybrid_search_filtered": q(ranked("fu", "score DESC", 10), f"{POSTINGS}, {ASKED}, {TEXTS}, wx AS (SELECT asked AS query_id, trace_id, span_id, score FROM sc JOIN dd USING (trace_id, span_id) JOIN tx ON sc.query_id = n WHERE tenant_id = 2), {vectors('l2', 'va')}, vd AS (SELECT va.* FROM va JOIN dd USING (trace_id, span_id) WHERE tenant_id = 2), {RRF}"),
    "search_joined": q(f"SELECT r.query_id, r.rank, r.score, d.agent_name, d.status, r.trace_id, r.span_id FROM ({ranked('sc', 'score DESC', 10)}) r JOIN dd d USING (trace_id, span_id)", f"{POSTINGS}, {ASKED}"),
    "eval_keyword": q("SELECT * FROM sc", f"{folded()}, {KEYWORDS}"),
    "eval_summary": summary("WITH sc AS (SELECT d.source AS agent_name, l.quality * 1000 AS eval_score FROM labels l JOIN documents d USING (doc_id))"),
    "eval_summary_keyword": summary(f"WITH {folded()}, {KEYWORDS}"),
    "eval_dataset_stricter": summary(f"WITH {folded()}, {KEYWORDS.replace(chr(39) + 'signup', chr(39) + 'click')}, unused AS (SELECT 1)".replace("FROM sp WHERE output_text IS NOT NULL", "FROM sp WHERE output_text IS NOT NULL AND status = 0")),
    "eval_writeback": q("SELECT s.trace_id, s.span_id, s.eval_score, s.eval_label, coalesce(sp.status, 0) AS status FROM sc s JOIN sp USING (trace_id, span_id)", f"{folded()}, {KEYWORDS}"),
    "dataset_collect": q("SELECT name, count(*) AS examples FROM (SELECT 'failed' AS name FROM sp WHERE status = 1 UNION ALL SELECT 'long' FROM sp WHERE duration_ns > 50000000) GROUP BY name"),
    "session_eval": q("SELECT session_id, count(*) AS turns, arg_max(NOT failed, turn_index) AS resolved, max(streak) OR max(again) AS looped, count(*) FILTER (failed) AS failed_turns, CASE WHEN NOT arg_max(NOT failed, turn_index) THEN 0 WHEN max(streak) OR max(again) THEN 500 ELSE 1000 END AS score, CASE WHEN NOT arg_max(NOT failed, turn_index) THEN '未解决' WHEN max(streak) OR max(again) THEN '绕圈后解决' ELSE '一次到位' END AS label FROM (SELECT *, failed AND coalesce(lag(failed) OVER (PARTITION BY session_id ORDER BY turn_index), false) AS streak, user_input IS NOT NULL AND count(user_input) OVER (PARTITION BY session_id, user_input) >= 2 AS again FROM (SELECT *, agent_output IS NULL OR contains(agent_output, 'avec') AS failed FROM tl)) GROUP BY session_id", TURNS),
    "compaction_equivalence": q(TRACES.format(where=""), folded(source="kept").replace("seen AS", f"{TOMBS},\nseen AS", 1)),
    "stored_traces": q(TRACES.format(where="")),
    "streamed_traces": q(TRACES.format(where="")),
    "wire_roundtrip": q("SELECT trace_id, span_id, seq, event_type::SMALLINT AS event_type, ext_span_id, status::SMALLINT AS status, duration_ns, input_tokens, model, input_text, log_line AS logs FROM ev"),
    "ingested_events": q("SELECT event_type::SMALLINT AS event_type, count(*) AS events FROM ev GROUP BY ALL", EVENTS),
    "bm25_index": q("SELECT count(*) AS n, sum(doc_len)::BIGINT AS total, count(*) AS known_n, sum(doc_len)::BIGINT AS known_total FROM st", POSTINGS),
    "bm25_similar": q(ranked("sc", "score DESC", 5), f"{POSTINGS}, qs AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0), qt AS{ASKED.split('qt AS', 1)[1]}"),
    "event_search": q(f"SELECT query_id, rank, score, trace_id, span_id, agent_name, event_count FROM ({ranked('sc', 'score DESC', 10)}) JOIN sp USING (trace_id, span_id)", f"{folded()}, {EVENT_TOKENS}, {asked(EVENT_QUERIES)}"),
    "event_search_filtered": q(f"SELECT query_id, rank, score, trace_id, span_id FROM ({ranked(f'(SELECT sc.* FROM sc JOIN sp USING (trace_id, span_id) JOIN fa USING (trace_id, span_id) WHERE tenant_id = 1 AND max_ts >= {WINDOW[0]} AND min_ts <= {WINDOW[1]})', 'score DESC', 10)})", f"{folded()}, {TIMES}, {EVENT_TOKENS}, {asked(EVENT_QUERIES)}"),
    "event_search_similar": q(f"SELECT query_id, rank, distance, trace_id, span_id FROM ({ranked('(SELECT vd.* FROM vd JOIN sp USING (trace_id, span_id) WHERE status = 0)', 'distance', 10)})", f"{folded()}, {vectors('l2')}"),
    "event_search_hybrid": q(f"SELECT query_id, rank, score, trace_id, span_id FROM ({ranked('fu', 'score DESC', 10)})", f"{folded()}, {EVENT_TOKENS}, {asked(EVENT_QUERIES)}, wx AS (SELECT e.vec_id AS query_id, trace_id, span_id, score FROM sc JOIN sp USING (trace_id, span_id), (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) e WHERE query_id = 1 AND tenant_id = 2), {vectors('l2', 'va')}, vd AS (SELECT va.* FROM va JOIN sp USING (trace_id, span_id) WHERE tenant_id = 2), {RRF}"),
    "chain_dfs": "WITH RECURSIVE sp AS (SELECT event_id // 1000 AS trace_id, event_id % 1000 AS span_id, CASE WHEN event_id % 1000 > 0 THEN event_id % 1000 - 1 END AS parent_span_id FROM events), pa AS (SELECT trace_id, span_id, 0::BIGINT AS visit FROM sp WHERE parent_span_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, p.visit + 1 FROM pa p JOIN sp s ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id) SELECT trace_id, span_id, visit FROM pa",
    "chain_depth": "SELECT event_id // 1000 AS trace_id, event_id % 1000 AS span_id, least(event_id % 1000, 65)::INT AS depth FROM events",
    "store_window": q(f"SELECT *, 1 AS segments FROM ({SPANS})", where=IN_WINDOW),
    "store_history": q("SELECT trace_id, 'pinned' AS version, count(*) AS spans, sum(event_count)::BIGINT AS events, NULL::BIGINT AS eval_score FROM sp GROUP BY trace_id UNION ALL SELECT trace_id, 'last', count(*), sum(n)::BIGINT, sum(eval_score)::BIGINT FROM (SELECT trace_id, span_id, count(*) AS n FROM once WHERE src_row % 13 <> 0 GROUP BY ALL) LEFT JOIN (SELECT event_id // 30 AS trace_id, (event_id % 30) // 3 AS span_id, max(CAST(round(value * 100) AS BIGINT) % 1001) AS eval_score FROM events WHERE event_id % 11 = 0 GROUP BY ALL) USING (trace_id, span_id) GROUP BY trace_id"),
    "store_replay": q("SELECT trace_id % 3 AS lsn, count(*) AS events FROM ev WHERE trace_id % 3 > 0 GROUP BY ALL"),
    "eval_store": q("SELECT trace_id, span_id, eval_score, eval_label FROM sc", f"{folded()}, {KEYWORDS}"),
    "streamed_sessions": q("SELECT session_id, count(*) AS events, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, count(*) FILTER (coalesce(status, 0) <> 0) AS errors FROM once GROUP BY session_id", EVENTS),
    "wire_tenant": q("SELECT 77::BIGINT AS tenant_id, count(*) AS events FROM ev", EVENTS),
    "tokens_cjk": r"SELECT doc_id, '反洗|洗钱|' || CASE WHEN source IS NULL THEN '' ELSE array_to_string(regexp_extract_all(lower(source), '[\p{L}\p{N}]+'), '|') || '|' END || '规则|abc|卡|9' AS tokens FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, '' FROM documents WHERE source IS NULL",
    "scalars_of_events": q(f"SELECT src_row, strftime(make_timestamp(ts // 1000000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at, CASE event_type WHEN 1 THEN 'start' WHEN 4 THEN 'log' ELSE 'end' END AS type, event_type::SMALLINT AS tag, {FNV.format(h='h')} AS derived, least(src_row, 1000)::INT AS clamped, crc FROM (SELECT *, {fnv(f'list_concat({le8(chr(116) + chr(115))}, {ASCII})')} AS h, CRC_OF AS crc FROM once)", EVENTS),
    "event_ids": q(f"SELECT ext_span_id, seq, event_type::SMALLINT AS event_type, {FNV.format(h='h')} AS event_id FROM (SELECT *, {fnv(f'list_concat({ASCII}, {le8(chr(115) + chr(101) + chr(113))}, [event_type::UBIGINT])')} AS h FROM once)", EVENTS),
    "otlp_forms": q("SELECT trace_id, trace_id * 10 + span_id + 1 AS span_id, CASE span_id % 3 WHEN 2 THEN 1 WHEN 1 THEN 0 END AS status, greatest(span_id * 5 - 10, 0) AS duration_ns, trace_id * 10 + 1 AS parent_span_id, span_id AS input_tokens, trace_id AS output_tokens, SESSION_OF AS session_id, 9::BIGINT AS tenant_id, agent_name, tool_name, model, 'first ' || model || chr(10) || 'second' AS input_text, 'said ' || ext_span_id AS output_text, 'step' AS logs, 2 AS event_count FROM once WHERE event_type = 1", EVENTS),
}
ORACLE["dataset_store"] = ORACLE["eval_dataset_stricter"]
#: IEEE CRC-32 of ASCII text, bit by bit.
_CRC = f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {ASCII}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))::BIGINT"
ORACLE["scalars_of_events"] = ORACLE["scalars_of_events"].replace("CRC_OF", _CRC)
_SESSION = fnv("list_transform(string_split('s' || (trace_id % 5)::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)")
ORACLE["otlp_forms"] = ORACLE["otlp_forms"].replace("SESSION_OF", FNV.format(h=_SESSION))
