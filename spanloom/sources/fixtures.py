"""The engine's inputs, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_EVENTS = """
select event_id div 30 as trace_id, (event_id % 30) div 3 as span_id, ts_ns as ts, event_id % 3 + 1 as seq,
 cast(case event_id % 3 when 0 then 1 when 1 then 4 else 2 end as smallint) as event_type,
 concat(cast(event_id div 30 as string), '-', cast((event_id % 30) div 3 as string)) as ext_span_id,
 cast(case when event_type = 'error' then 1 when event_type = 'view' then null else 0 end as smallint) as status,
 case when event_id % 3 = 2 then cast(round(value * 100) as bigint) * 10000 end as duration_ns,
 case when (event_id % 30) div 3 > 0 then ((event_id % 30) div 3 - 1) div 2 end as parent_span_id,
 case when event_id % 3 = 0 then k end as input_tokens, case when event_id % 3 = 2 then k * 2 end as output_tokens,
 (event_id div 30) % 50 as session_id, (event_id div 30) % 3 as tenant_id,
 case when (event_id % 30) div 3 % 3 < 2 then concat('agent', cast(user_id % 5 as string)) end as agent_name,
 case when (event_id % 30) div 3 % 3 = 2 then concat('tool', cast(user_id % 4 as string)) end as tool_name,
 case when k % 2 = 0 then 'model-a' else 'model-b' end as model,
 case when event_id % 3 = 0 then concat('ask ', event_type, ' ', cast(k as string)) end as input_text,
 case when event_id % 3 = 2 and event_type <> 'view' then concat('done ', event_type) end as output_text,
 array(event_type) as logs, event_id as src_row
from (select event_id, user_id, event_type, value, unix_micros(cast(ts as timestamp)) * 1000 as ts_ns, cast(get_json_object(props, '$.k') as bigint) as k from {events})
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of traces of up to ten spans; every seventh is sent twice. Scan order is src_row."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the table holds local times without a zone
    once = spark.sql(SPAN_EVENTS, events=_table(spark, sf_dir, "events"))
    return once.withColumn("_n", F.explode(F.when(F.col("src_row") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_n")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter("event_id % 13 = 0").select(F.col("event_id").alias("src_row"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").filter("event_id % 11 = 0").selectExpr("event_id div 30 as trace_id", "(event_id % 30) div 3 as span_id", "0L as segment_id", "event_id as patch_seq", "cast(case when event_type = 'purchase' then 2 end as smallint) as status", "cast(cast(round(value * 100) as bigint) % 1001 as int) as eval_score", "concat('lbl-', event_type) as eval_label")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id div 10 as trace_id", "doc_id % 10 as span_id", "text", "source as agent_name", "cast(case when doc_id % 4 = 0 then 1 else 0 end as smallint) as status", "doc_id % 3 as tenant_id")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").selectExpr("vec_id div 10 as trace_id", "vec_id % 10 as span_id", "embedding", "label", "vec_id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of conversations: a trace for each user turn and what follows it."""
    return spark.sql("""select conv_id as session_id, conv_id * 1000 + cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as trace_id, turn as span_id,
 case when role = 'user' then text end as input_text, case when role = 'assistant' then text end as output_text, cast(null as string) as agent_name, cast(0 as smallint) as status, cast(null as int) as eval_score, cast(length(text) as bigint) as duration_ns, cast(1 as bigint) as input_tokens, cast(2 as bigint) as output_tokens from {c}""", c=_table(spark, sf_dir, "conversations"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return lab.join(d.select("doc_id", "source"), "doc_id").selectExpr("source as agent_name", "doc_id div 10 as trace_id", "doc_id % 10 as span_id", "quality * 1000 as eval_score")
