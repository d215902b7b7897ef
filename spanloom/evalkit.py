"""Synthetic agent traces, and harnesses that ingest, score and sum them up, so that scorers can be held against known failures.

Everything is drawn by seeded hashes of row numbers, so the same seed gives the same events on any cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import evals, views
from spanloom.operators.fold import TraceQuery
from spanloom.sources.store import TraceStore

BAND = 100_000_000
STRICTER = ["maybe", "perhaps"]


@dataclass(frozen=True)
class Scenario:
    key: str
    agents: tuple[str, ...]
    tools: tuple[str, ...]
    model: str
    prompts: tuple[str, ...]
    good: tuple[str, ...]
    bad: tuple[str, ...]
    failing: float


SCENARIOS = (
    Scenario("support", ("helper", "greeter"), ("lookup", "refund"), "model-s", ("Where is my parcel?", "I was charged twice.", "How do I change my plan?", "My login fails."), ("It arrives tomorrow.", "The charge is returned.", "It is changed, perhaps look again later."), ("error: no answer", "抱歉, not possible"), 0.2),
    Scenario("review", ("reviewer",), ("diff", "lint", "run"), "model-r", ("Review this change.", "Is this query safe?", "Why does the build break?"), ("The change is fine.", "Use a parameter there.", "It is maybe a missing import."), ("error: cannot read the file", "失败"), 0.3),
    Scenario("research", ("planner", "reader"), ("search", "fetch"), "model-l", ("Compare the two reports.", "Sum up the paper.", "Find the source of the figure."), ("The second is newer.", "It shows a small effect.", "The figure comes from the census."), ("无法 open the page", "error: timeout"), 0.1),
    Scenario("booking", ("agent",), ("calendar", "mail"), "model-s", ("Book a room for four.", "Move the call to Monday.", "Cancel my seat."), ("Booked.", "Moved.", "Cancelled, perhaps with a fee."), ("error: no room", "抱歉"), 0.4),
)


def _draw(seed: int, *what) -> Column:
    """A number from 0 to 1 that depends on the row and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *what), 11) * F.lit(2.0**-53)


def _pick(options: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.least(F.floor(u * len(options)), F.lit(len(options) - 1)) + 1).cast("int"))


def _events(turns: DataFrame, sc: Scenario, seed: int) -> DataFrame:
    """Start and end events of three spans for each turn: the agent, its tool, the answer. Turns: trace_id, ts, session_id, prompt, good."""
    u = lambda name: _draw(seed, F.lit(name), F.col("trace_id"))
    answer = F.when(F.col("good"), _pick(sc.good, u("good"))).otherwise(_pick(sc.bad, u("bad")))
    tokens = {"input_tokens": F.floor(200 + u("in") * 1300), "output_tokens": F.floor(50 + u("out") * 550)}
    status = F.when(F.col("good"), 0).otherwise(1)
    agent = _pick(sc.agents, u("agent"))
    none = F.lit(None)
    spans = F.array(*(
        F.struct(F.lit(n).cast("bigint").alias("span_id"), parent.cast("bigint").alias("parent_span_id"), a.cast("string").alias("agent_name"), t.cast("string").alias("tool_name"), o.cast("string").alias("output_text"), s.cast("smallint").alias("status"), i.cast("bigint").alias("input_tokens"), k.cast("bigint").alias("output_tokens"), F.floor(500_000 + _draw(seed, F.lit(n), F.col("trace_id")) * 4_500_000).alias("duration_ns"))
        for n, parent, a, t, o, s, i, k in ((1, none, agent, none, none, F.lit(0), tokens["input_tokens"], F.lit(0)), (2, F.lit(1), none, _pick(sc.tools, u("tool")), none, status, F.lit(0), F.lit(0)), (3, F.lit(1), agent, none, answer, status, tokens["input_tokens"], tokens["output_tokens"]))
    ))
    rows = turns.select("trace_id", "ts", "session_id", "prompt", F.explode(spans).alias("s")).select("trace_id", "ts", "session_id", "prompt", "s.*")
    rows = rows.withColumns({"ext_span_id": F.concat_ws("-", "trace_id", "span_id"), "model": F.lit(sc.model), "t": F.col("ts") + F.col("span_id") - 1})
    start = F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit(1).cast("smallint").alias("event_type"), F.col("t").alias("at"), F.col("prompt").alias("input_text"), F.lit(None).cast("string").alias("out"), F.lit(None).cast("smallint").alias("st"), F.lit(None).cast("bigint").alias("took"))
    end = F.struct(F.lit(2).cast("bigint").alias("seq"), F.lit(2).cast("smallint").alias("event_type"), (F.col("t") + F.col("duration_ns")).alias("at"), F.lit(None).cast("string").alias("input_text"), F.col("output_text").alias("out"), F.col("status").alias("st"), F.col("duration_ns").alias("took"))
    both = rows.withColumn("e", F.explode(F.array(start, end)))
    return both.select("trace_id", "span_id", F.col("e.at").alias("ts"), "e.seq", "e.event_type", "ext_span_id", F.col("e.st").alias("status"), F.col("e.took").alias("duration_ns"), "parent_span_id", "input_tokens", "output_tokens", "session_id", "agent_name", "tool_name", "model", "e.input_text", F.col("e.out").alias("output_text"))


def scenario_turns(spark: SparkSession, number: int, n: int, seed: int = 1) -> DataFrame:
    """A turn for each of ``n`` traces of a scenario, in a band of time of its own."""
    sc = SCENARIOS[number]
    i = F.col("id")
    return spark.range(n).select(((number + 1) * 100_000_000 + i).alias("trace_id"), (F.lit(number * BAND * 1000) + i * 1000).alias("ts"), F.lit(None).cast("bigint").alias("session_id"), _pick(sc.prompts, _draw(seed, F.lit("prompt"), F.lit(number), i)).alias("prompt"), (_draw(seed, F.lit("fails"), F.lit(number), i) >= sc.failing).alias("good"))


def scenario_events(spark: SparkSession, number: int, n: int, seed: int = 1) -> DataFrame:
    return _events(scenario_turns(spark, number, n, seed), SCENARIOS[number], seed)


#: Arcs of conversations with their shares: solved at once, after two failures, after the same question again, never.
ARCS = (("fast", 0.40), ("retry", 0.25), ("repeat", 0.15), ("unresolved", 0.20))


def conversation_turns(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """The turns of ``n`` sessions; ``arc`` says how each goes. Prompts of one session differ but in the arc that repeats one."""
    sc, u, arc, low = SCENARIOS[0], _draw(seed, F.lit("arc"), F.col("id")), F.lit(None), 0.0
    for name, share in reversed(ARCS):
        arc = F.when(u < sum(s for _, s in ARCS[: [a for a, _ in ARCS].index(name) + 1]), name).otherwise(arc) if name != ARCS[-1][0] else F.lit(name)
    goods = F.when(F.col("arc") == "fast", F.array(F.lit(True))).when(F.col("arc") == "retry", F.array(F.lit(False), F.lit(False), F.lit(True))).when(F.col("arc") == "repeat", F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(False), F.lit(False), F.lit(False)))
    turns = spark.range(n).withColumn("arc", arc).select("id", "arc", F.posexplode(goods).alias("turn", "good"))
    first = F.floor(_draw(seed, F.lit("prompt"), F.col("id")) * len(sc.prompts))
    at = F.pmod(first + F.when(F.col("arc") == "repeat", 0).otherwise(F.col("turn")), F.lit(len(sc.prompts)))
    return turns.select((F.lit(900_000_000) + F.col("id") * 10 + F.col("turn")).alias("trace_id"), ((F.col("id") * 10 + F.col("turn")) * 1000).alias("ts"), (F.lit(50_000) + F.col("id")).alias("session_id"), F.element_at(F.array(*map(F.lit, sc.prompts)), (at + 1).cast("int")).alias("prompt"), "good", "arc")


def conversation_events(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    return _events(conversation_turns(spark, n, seed), SCENARIOS[0], seed)


def run_harness(store: TraceStore, n: int, seed: int = 1, bad: list[str] = evals.BAD_WORDS) -> DataFrame:
    """Scenarios into a store, scored and written back in their own windows of time; what each scored beside what was made to fail.

    scenario, traces, injected_failures, scored, passed, pass_rate, cost_tokens; the last two rows are the regression set of
    the second scenario under the scorer and under a stricter one.
    """
    spark, out = store.spark, None
    for number, sc in enumerate(SCENARIOS):
        turns = scenario_turns(spark, number, n, seed)
        store.append(scenario_events(spark, number, n, seed))
        window = TraceQuery(time_from=number * BAND * 1000, time_to=(number + 1) * BAND * 1000 - 1)
        store.evaluate(evals.keyword_scorer(bad), window)
        spans = store.spans(window)
        made = turns.agg(F.count("*").alias("traces"), F.count_if(~F.col("good")).alias("injected_failures"))
        scored = evals.eval_summary(spans, 1000).filter("agent_name is null").select("scored", "passed", "pass_rate")
        cost = views.cost_by_agent(spans).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("cost_tokens"))
        row = made.crossJoin(scored).crossJoin(cost).select(F.lit(sc.key).alias("scenario"), "*")
        out = row if out is None else out.unionByName(row)
        if number == 1:
            store.collect("regression", "output_text is not null", window)
    for name, words in (("regression", bad), ("regression stricter", [*bad, *STRICTER])):
        summed = evals.eval_dataset(store.datasets(), "regression", evals.keyword_scorer(words), 1000).filter("agent_name is null")
        out = out.unionByName(summed.select(F.lit(name).alias("scenario"), F.col("scored").alias("traces"), F.lit(None).cast("bigint").alias("injected_failures"), "scored", "passed", "pass_rate", F.lit(None).cast("bigint").alias("cost_tokens")))
    return out


def run_session_harness(store: TraceStore, n: int, seed: int = 1) -> DataFrame:
    """Conversations into a store, scored by session: sessions by arc and label, with their mean number of turns."""
    spark = store.spark
    store.append(conversation_events(spark, n, seed))
    scored = evals.score_sessions(views.session_timeline(store.spans()))
    arcs = conversation_turns(spark, n, seed).select("session_id", "arc").distinct()
    return scored.join(arcs, "session_id").groupBy("arc", "label").agg(F.count("*").alias("sessions"), F.round(F.avg("turns"), 6).alias("avg_turns"))
