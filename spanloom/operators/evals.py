"""Scoring spans and sessions, summaries, frozen datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scalars import clamp_score
from spanloom.sources.schema import DATASETS

#: A scorer gives struct<score, label> or null (not scored) from a span's columns.
Scorer = Callable[[], Column]
BAD_WORDS = ["无法", "抱歉", "失败", "error"]
PASS, FAIL = "通过", "未通过"


def outcome(score: Column, label: Column) -> Column:
    return F.struct(clamp_score(score).alias("score"), label.alias("label"))


def keyword_scorer(bad: list[str] = BAD_WORDS) -> Scorer:
    """0 for an output with one of the words, else 1000; a span without output isn't scored."""

    def score() -> Column:
        hit = F.lit(False)
        for word in bad:
            hit = hit | F.col("output_text").contains(word)
        return F.when(F.col("output_text").isNotNull(), F.when(hit, outcome(F.lit(0), F.lit(FAIL))).otherwise(outcome(F.lit(1000), F.lit(PASS))))

    return score


def score_spans(spans: DataFrame, scorer: Scorer) -> DataFrame:
    """The scored spans: trace_id, span_id, agent_name, eval_score, eval_label."""
    out = spans.withColumn("_o", scorer()).filter("_o is not null")
    return out.select("trace_id", "span_id", "agent_name", F.col("_o.score").alias("eval_score"), F.col("_o.label").alias("eval_label"))


def writeback(spans: DataFrame, scorer: Scorer, segments: DataFrame, patch_seq: int | None = None) -> DataFrame:
    """Scores as late patches of the lowest segment that holds each span (trace_id, span_id, segment_id in ``segments``); a store numbers them itself."""
    home = segments.groupBy("trace_id", "span_id").agg(F.min("segment_id").alias("segment_id"))
    out = score_spans(spans, scorer).drop("agent_name").join(home, ["trace_id", "span_id"])
    return out if patch_seq is None else out.withColumn("patch_seq", F.lit(patch_seq).cast("bigint"))


def _aggregate(score: str, threshold: int) -> list[Column]:
    n, s = F.count(score), F.coalesce(F.sum(score), F.lit(0)).cast("bigint")
    return [n.alias("scored"), F.count_if(F.col(score) >= threshold).alias("passed"), F.when(n > 0, F.call_function("div", s, F.greatest(n, F.lit(1)))).otherwise(0).cast("bigint").alias("avg_score")]


def eval_summary(scored: DataFrame, threshold: int = 600, score: str = "eval_score") -> DataFrame:
    """The overall row (null agent, present even if nothing is scored), then one for each agent; pass rate from 0 to 1."""
    own = scored.filter(F.col(score).isNotNull())
    overall = own.agg(*_aggregate(score, threshold)).select(F.lit(None).cast("string").alias("agent_name"), "*")
    agents = own.filter(F.col("agent_name").isNotNull()).groupBy("agent_name").agg(*_aggregate(score, threshold))
    rate = F.when(F.col("scored") > 0, F.round(F.col("passed") / F.greatest(F.col("scored"), F.lit(1)), 6)).otherwise(0.0)
    return overall.unionByName(agents).withColumn("pass_rate", rate)


def collect_examples(name: str, spans: DataFrame, condition: Column | str, existing: DataFrame | None = None, expected: Column | None = None) -> DataFrame:
    """Snapshots of the matching spans that the dataset doesn't hold yet."""
    chosen = spans.filter(condition).withColumns({"name": F.lit(name), "expected": (F.lit(None) if expected is None else expected).cast("string")})
    chosen = chosen.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in DATASETS))
    if existing is None:
        return chosen
    return chosen.join(existing.filter(F.col("name") == name).select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti").select(*DATASETS.names)


def list_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.groupBy("name").agg(F.count("*").alias("examples"))


def eval_dataset(datasets: DataFrame, name: str, scorer: Scorer, threshold: int = 600) -> DataFrame | None:
    """The summary of a scorer over frozen examples; None for a name that doesn't exist."""
    own = datasets.filter(F.col("name") == name)
    if own.isEmpty():
        return None
    return eval_summary(score_spans(own, scorer), threshold)


def turn_failed(bad: list[str] = BAD_WORDS) -> Column:
    hit = F.col("agent_output").isNull() | (F.col("error_count") > 0)
    for word in bad:
        hit = hit | F.coalesce(F.col("agent_output").contains(word), F.lit(False))
    return hit


def score_sessions(timeline: DataFrame, bad: list[str] = BAD_WORDS) -> DataFrame:
    """Each session from its turns: resolved if the last turn didn't fail; looped if two turns in a row failed or a question was repeated."""
    w = W.partitionBy("session_id").orderBy("turn_index")
    turns = timeline.withColumn("failed", turn_failed(bad))
    turns = turns.withColumn("streak", F.col("failed") & F.coalesce(F.lag("failed").over(w), F.lit(False)))
    asked = F.count(F.when(F.col("user_input").isNotNull(), 1)).over(W.partitionBy("session_id", "user_input"))
    turns = turns.withColumn("again", F.col("user_input").isNotNull() & (asked >= 2))
    out = turns.groupBy("session_id").agg(F.count("*").alias("turns"), (~F.max_by("failed", "turn_index")).alias("resolved"), (F.max("streak") | F.max("again")).alias("looped"), F.count_if("failed").alias("failed_turns"))
    score = F.when(~F.col("resolved"), 0).when(F.col("looped"), 500).otherwise(1000)
    label = F.when(~F.col("resolved"), "未解决").when(F.col("looped"), "绕圈后解决").otherwise("一次到位")
    return out.withColumns({"score": score, "label": label})
