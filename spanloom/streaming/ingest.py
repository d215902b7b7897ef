"""Structured Streaming: wire and OTLP files into a store, and session totals kept as state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.fold import EVENT
from spanloom.sources.files import Files
from spanloom.sources.otlp import parse_otlp
from spanloom.sources.schema import EVENTS
from spanloom.sources.store import TraceStore
from spanloom.sources.wire import parse_wire


def wire_stream(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    """A stream of wire bodies: a JSON array on each line of the files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder).withColumnRenamed("value", "body")


def event_stream(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    """A stream of events from Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def run(stream: DataFrame, store: TraceStore, checkpoint: str, name: str = "ingest", tenant_id: int | None = None, override_tenant: bool = False, strict: bool = True, otlp: bool = False, wait: bool = True, every: str | None = None):
    """Appends every micro-batch as a segment. A batch that is replayed after a failure is recognised by its number and written once.

    Without ``every`` all that is there is taken and the stream ends; with it (such as '30 seconds') it goes on.
    """

    def write(bodies: DataFrame, batch: int) -> None:
        events = bodies
        if "body" in bodies.columns:
            events = parse_otlp(bodies, tenant_id=tenant_id, strict=strict) if otlp else parse_wire(bodies, tenant_id=tenant_id, override_tenant=override_tenant, strict=strict)
        elif override_tenant:
            events = bodies.withColumn("tenant_id", F.lit(tenant_id).cast("bigint"))
        store.append(events, batch=(name, batch))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    started = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if wait and not every:
        started.awaitTermination()
    return started


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without retransmissions that come within ``delay``; state older than that goes. Reads still remove the rest.

    The state holds the columns of an event's identity themselves; their hash, byte by byte, isn't needed for it.
    """
    timed = events.withColumn("event_time", F.timestamp_micros((F.col("ts") / 1000).cast("bigint")))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(EVENT)


def session_totals(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running tokens, events and failures of each session: the incremental session view, as built-in aggregation state."""
    needed = events.select("ts", *EVENT, "session_id", "input_tokens", "output_tokens", "status")
    own = deduplicated(needed, delay).filter(F.col("session_id").isNotNull())
    return own.groupBy("session_id").agg(F.count("*").alias("events"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.count_if(F.coalesce(F.col("status"), F.lit(0)) != 0).alias("errors"))


def activity(events: DataFrame, width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Events, failures and tokens by tumbling window of event time."""
    return deduplicated(events, delay).groupBy(F.window("event_time", width)).agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.col("status"), F.lit(0)) != 0).alias("errors"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", "errors", "input_tokens")


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams that start within keep their state in RocksDB: an executor's heap holds none of it. The session's own settings return."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class SessionView:
    """Session totals kept beside a stream in update mode: a micro-batch's changed rows replace the old ones.

    Each batch writes a folder of its own and the view reads the last row of each session, so a batch that is run again
    after a failure replaces itself. ``compact`` keeps one folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = "session_id bigint, events bigint, input_tokens bigint, output_tokens bigint, errors bigint, batch bigint"

    def merge(self, changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/b{batch:012d}")

    def read(self) -> DataFrame:
        names = Files(self.spark, self.path).names("")
        if not names:
            return self.spark.createDataFrame([], self.schema).drop("batch")
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names))
        values = ["events", "input_tokens", "output_tokens", "errors"]
        return rows.groupBy("session_id").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("session_id", "v.*")

    def compact(self) -> None:
        """One folder instead of all so far, for a stream that is stopped. It repeats the last batch's number, so reads are right at any moment."""
        files = Files(self.spark, self.path)
        names = files.names("")
        if len(names) > 1:
            self.read().withColumn("batch", F.lit(int(names[-1][1:13])).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/{names[-1][:13]}-all")
            for n in names:
                if n != f"{names[-1][:13]}-all":
                    files.delete(n)
