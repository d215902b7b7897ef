"""A versioned event store: immutable Parquet segments, tombstones, late patches, and one manifest file per version.

A change writes its rows first and then publishes the next manifest, which appears whole and only once. Readers name a
version (or take the last) and see the same rows however the store goes on. A manifest that can't be read, such as the torn
one of a writer that died, is no version; a store whose every manifest is torn is empty. Patches, tombstones and vectors
are numbered by the commit that publishes them, so no two share a number. A row keeps the number of its append however
segments are merged: a replay and the text index go by rows' numbers, not by segments.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.tokenize import bigrams
from spanloom.operators import evals, fold, search, views
from spanloom.operators.fold import TraceQuery
from spanloom.operators.nearest import VectorIndex, vector_batch
from spanloom.operators.search import latest_embeddings
from spanloom.operators.textindex import TextIndex, hybrid
from spanloom.sources.files import Files, scratch, written
from spanloom.sources.schema import DATASETS, EMBEDDINGS, EVENTS, PATCHES, STORED, TOMBSTONES

__all__ = ["FORMAT", "FormatError", "TraceStore", "scratch"]

FORMAT = 2
ORDER = ["segment_id", "row_idx"]
EMPTY = {"version": 0, "format": FORMAT, "segments": [], "patches": [], "tombstones": [], "embeddings": [], "datasets": [], "text": None, "vectors": None, "next_segment": 1, "next_seq": 1, "batches": {}}
#: Rows of live segments from which an append seals them.
FLUSH_ROWS = 1_000_000


def folders(manifest: dict) -> list[str]:
    """All that a version names."""
    return [*(s["folder"] for s in manifest["segments"]), *(f for kind in ("patches", "tombstones", "embeddings") for f, _ in manifest[kind]), *manifest["datasets"], *(manifest["text"]["folders"] if manifest["text"] else []), *([manifest["vectors"]] if manifest["vectors"] else [])]


def _first(segment: dict) -> int:
    """The least number of an append that a segment has rows of; its ``lsn`` is the largest."""
    return segment.get("first_lsn", segment["lsn"])


def _indexed(text: dict | None, segments: list[dict]) -> int:
    """The last append whose rows a text index has. Manifests of before named segments instead."""
    if not text:
        return 0
    return text["lsn"] if "lsn" in text else max((s["lsn"] for s in segments if s["id"] in text["segments"]), default=0)


class FormatError(RuntimeError):
    """The manifest was written by another format version."""


class TraceStore:
    def __init__(self, spark: SparkSession, path: str, flush_rows: int = FLUSH_ROWS):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.flush_rows = flush_rows
        self.check_format()

    # versions

    def _names(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names("manifest") if n.startswith("v") and n.endswith(".json"))

    def _load(self, version: int) -> dict | None:
        """What a manifest says; None if it is torn."""
        try:
            found = json.loads(self.files.read(f"manifest/v{version:012d}.json"))
        except ValueError:
            return None
        return found if isinstance(found, dict) and {"version", "format"} <= set(found) else None

    def versions(self) -> list[int]:
        return [v for v in self._names() if self._load(v)]

    def manifest(self, version: int | None = None) -> dict:
        """One version, or the last that can be read."""
        if version is None:
            return next((m for v in reversed(self._names()) if (m := self._load(v))), EMPTY)
        found = EMPTY if version == 0 else self._load(version)
        if found is None:
            raise ValueError(f"the manifest of version {version} is torn")
        return found

    def check_format(self) -> None:
        found = self.manifest()["format"]
        if found != FORMAT:
            raise FormatError(f"the store has format {found}, this engine {FORMAT}")

    def _commit(self, change: Callable[[dict], dict | None], tries: int = 20) -> int:
        """Applies a change to the last manifest and publishes the result; another writer's version in between is taken in."""
        for _ in range(tries):
            base = self.manifest()
            new = change(json.loads(json.dumps(base)))
            if new is None:
                return base["version"]
            new["version"] = max([base["version"], *self._names()]) + 1
            if self.files.publish(f"manifest/v{new['version']:012d}.json", json.dumps(new)):
                return new["version"]
            time.sleep(0.05)
        raise RuntimeError("other writers kept committing")

    def _write(self, df: DataFrame, kind: str) -> str:
        """A folder of rows. Segments have a Bloom filter of their traces, so a read of few traces skips the others' row groups."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        out = df.write.option("parquet.bloom.filter.enabled#trace_id", "true") if kind == "segments" else df.write
        out.parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, numbered: list[list], schema, number: str) -> DataFrame:
        """The rows of folders with the number of each as a column."""
        if not numbered:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f, _ in numbered))
        ids = F.create_map(*(x for f, n in numbered for x in (F.lit(f.split("/")[1]), F.lit(n).cast("bigint"))))
        return read.withColumn(number, ids[F.regexp_extract(F.col("_metadata.file_path"), "/([0-9a-f]{32})/", 1)])

    # writes

    def append(self, events: DataFrame, order: list[str] | None = None, batch: tuple[str, int] | None = None, level: int = 0) -> int:
        """A new segment. ``batch`` (stream name, number) is written once: a replayed or older number changes nothing."""
        if batch and self.manifest()["batches"].get(batch[0], -1) >= batch[1]:
            return self.manifest()["version"]
        have = set(events.columns)
        if order and len(order) > 1:  # ids rise along the range partitions
            events = events.repartitionByRange(*order).sortWithinPartitions(*order)
        row = F.col(order[0]).cast("bigint") if order and len(order) == 1 else F.monotonically_increasing_id()
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS]
        folder = self._write(events.select(*columns, row.alias("row_idx")), "segments")
        version = self._add_segment(folder, level, batch)
        live = [x for x in self.manifest()["segments"] if x["state"] == "live"]
        return self.flush() if len(live) > 1 and sum(x["rows"] for x in live) >= self.flush_rows else version

    def flush(self) -> int:
        """Seals the live tail: all live segments become one. Rows keep their order; what is deleted stays deleted."""
        return self._merge([x["id"] for x in self.manifest()["segments"] if x["state"] == "live"])

    def replay(self, after: int = 0) -> DataFrame:
        """The rows that were appended after a log number; ``lsn`` is the number of a row's append, in merged segments too."""
        return self._stored([x for x in self.manifest()["segments"] if x["lsn"] > after]).filter(F.col("lsn") > after)

    def _zone(self, folder: str) -> dict:
        low, high, rows = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.min("ts"), F.max("ts"), F.count("*")).first()
        return {"folder": folder, "min_ts": low, "max_ts": high, "rows": rows}

    def _add_segment(self, folder: str, level: int, batch: tuple[str, int] | None = None, instead: list[int] | None = None, expect: int | None = None) -> int:
        zone = self._zone(folder)

        def change(m: dict) -> dict | None:
            if batch:
                if m["batches"].get(batch[0], -1) >= batch[1]:
                    return None
                m["batches"][batch[0]] = batch[1]
            if expect is not None and m["version"] != expect:
                raise InterruptedError
            if zone["rows"]:
                merged = [s for s in m["segments"] if s["id"] in (instead or [])]
                numbers = {"lsn": max(s["lsn"] for s in merged), "first_lsn": min(map(_first, merged))} if merged else {"lsn": m["next_seq"]}
                m["segments"].append({"id": m["next_segment"], "level": level, "state": "live" if instead is None else "sealed", **numbers, **zone})
                m["next_segment"] += 1
                m["next_seq"] += not merged
            if instead is not None:
                m["segments"] = [s for s in m["segments"] if s["id"] not in instead]
                m["tombstones"] = m["tombstones"] if m["segments"][:-1] else []
            return m

        return self._commit(change)

    def _numbered(self, kind: str, folder: str) -> int:
        """Names a folder of rows in the next version, with the number that its rows have there."""
        return self._commit(lambda m: m | {kind: [*m[kind], [folder, m["next_seq"]]], "next_seq": m["next_seq"] + 1})

    def delete(self, rows: DataFrame) -> int:
        """Tombstones for (segment_id, row_idx)."""
        return self._numbered("tombstones", self._write(rows.select("segment_id", "row_idx"), "tombstones"))

    def upgrade(self, patches: DataFrame) -> int:
        """Late values by span (trace_id, span_id and any of the folded columns; segment_id defaults to the lowest). Identity can't change."""
        have = set(patches.columns)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else (F.lit(0) if f.name == "segment_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in PATCHES if f.name != "patch_seq"]
        return self._numbered("patches", self._write(patches.select(*columns), "patches"))

    def index_embedding(self, vectors: DataFrame) -> int:
        return self._numbered("embeddings", self._write(vectors.select("trace_id", "span_id", F.col("embedding").cast("array<float>").alias("embedding")), "embeddings"))

    # reads

    def segments(self, query: TraceQuery = TraceQuery(), version: int | None = None) -> list[dict]:
        """The segments whose times meet the query's."""
        low = -(1 << 63) if query.time_from is None else query.time_from
        high = (1 << 63) - 1 if query.time_to is None else query.time_to
        return [s for s in self.manifest(version)["segments"] if s["max_ts"] >= low and s["min_ts"] <= high]

    def _stored(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], STORED)
        schema = [f.name for f in STORED if f.name != "segment_id"]
        read = self.spark.read.schema(STORED)
        df = read.parquet(*(f"{self.path}/{s['folder']}" for s in segments)).select(*schema, F.regexp_extract(F.col("_metadata.file_path"), "segments/([0-9a-f]{32})/", 1).alias("_folder"))
        numbers = lambda n: F.create_map(*(x for s in segments for x in (F.lit(s["folder"].split("/")[1]), F.lit(s[n]).cast("bigint"))))[F.col("_folder")]
        return df.withColumns({"segment_id": numbers("id"), "lsn": F.coalesce("lsn", numbers("lsn"))}).drop("_folder")

    def events(self, query: TraceQuery = TraceQuery(), version: int | None = None) -> DataFrame:
        """Live stored events with their places."""
        return query.events(self._live(self.manifest(version), self.segments(query, version)))

    def _live(self, m: dict, segments: list[dict]) -> DataFrame:
        out = self._stored(segments)
        return fold.drop_tombstones(out, self._read(m["tombstones"], TOMBSTONES, "deletion_seq"), ORDER) if m["tombstones"] else out

    def spans(self, query: TraceQuery = TraceQuery(), version: int | None = None, keys: DataFrame | None = None, scope: str = "global", window_mode: str = "events") -> DataFrame:
        m = self.manifest(version)
        patches = self._read(m["patches"], PATCHES, "patch_seq") if m["patches"] else None
        within = query if window_mode == "events" else TraceQuery(trace_id=query.trace_id)
        return fold.spans(self.events(within, version), ORDER, query, patches=patches, keys=keys, scope=scope, window_mode=window_mode)

    def embeddings(self, version: int | None = None) -> DataFrame:
        return latest_embeddings(self._read(self.manifest(version)["embeddings"], EMBEDDINGS, "lsn"))

    # search

    def text_index(self, version: int | None = None, tokenizer: Callable[[Column], Column] = bigrams) -> TextIndex:
        known = self.manifest(version)["text"]
        return TextIndex(self.spark, self.path, *((known[c] for c in ("folders", "n", "total", "whole")) if known else ()), tokenizer=tokenizer)

    def index_text(self, compact: bool = False, tokenizer: Callable[[Column], Column] = bigrams) -> int:
        """Adds the rows that aren't indexed yet to the text index, without events that an indexed row has already."""
        m = self.manifest()
        done = _indexed(m["text"], m["segments"])
        fresh = [x for x in m["segments"] if x["lsn"] > done]
        index = self.text_index(m["version"], tokenizer)
        if fresh:
            events = fold.dedup(self._live(m, fresh).filter(F.col("lsn") > done), ORDER, "global")
            old = [x for x in m["segments"] if _first(x) <= done]
            if old:
                events = events.join(self._stored(old).filter(F.col("lsn") <= done).select(*fold.EVENT), fold.EVENT, "left_anti")
            index = index.add(search.search_text(events))
        if compact and (len(index.folders) > 1 or not index.whole):
            index = index.compact()

        def change(now: dict) -> dict | None:
            if now["text"] != m["text"]:
                raise RuntimeError("another writer indexed meanwhile")
            return now | {"text": {"folders": index.folders, "n": index.n, "total": index.total, "whole": index.whole, "lsn": max([done, *(x["lsn"] for x in fresh)])}}

        return self._commit(change)

    def index_vectors(self, lists: int = 64, metric: str = "l2") -> int:
        """An inverted file over the last vector of each span, for approximate search."""
        folder = f"vectors/{uuid.uuid4().hex}"
        VectorIndex.build(self.embeddings(), f"{self.path}/{folder}", lists, metric)
        return self._commit(lambda m: m | {"vectors": folder})

    def vector_index(self, version: int | None = None) -> VectorIndex | None:
        folder = self.manifest(version)["vectors"]
        return VectorIndex(self.spark, f"{self.path}/{folder}") if folder else None

    def attributes(self, version: int | None = None) -> DataFrame:
        """What filters ask of spans."""
        return views.filter_attrs(self.spans(version=version), self.events(version=version))

    def search(self, queries: DataFrame, k: int = 10, wanted: search.SearchFilter | Column | str | None = None, metric: str = "l2", version: int | None = None) -> DataFrame:
        """Text search, vector search or both, as the columns of ``queries`` (query_id; query, vector) say; hits in the snapshot only, with their spans, in rank order.

        A filter is asked before the ranking, so it costs no hits.
        """
        asked = set(queries.columns) & {"query", "vector"}
        if not asked:
            raise ValueError("queries need a column query, vector, or both")
        attrs = self.attributes(version) if wanted is not None else None
        if asked == {"query"}:
            found = self.text_index(version).search(queries, k, attrs, wanted)
        elif asked == {"vector"}:
            found = vector_batch(search.restrict(self.embeddings(version), attrs, wanted), queries, k, metric)
        else:
            found = hybrid(self.text_index(version), self.embeddings(version), queries, k, metric, attrs, wanted)
        found = written(found, "hits")
        return search.join_spans(found, self.spans(version=version, keys=found))

    # evaluation

    def evaluate(self, scorer: evals.Scorer, query: TraceQuery = TraceQuery()) -> int:
        """Scores the spans of a query and writes the scores back as late patches of the segments that hold the spans."""
        m = self.manifest()
        homes = self._stored(self.segments(query, m["version"])).select("trace_id", "span_id", "segment_id")
        return self.upgrade(evals.writeback(self.spans(query, m["version"]), scorer, homes))

    def collect(self, name: str, condition: Column | str, query: TraceQuery = TraceQuery(), expected: Column | None = None) -> int:
        """Freezes the matching spans that the dataset doesn't hold yet; a dataset begins with its first collection."""
        m = self.manifest()
        folder = self._write(evals.collect_examples(name, self.spans(query, m["version"]), condition, self.datasets(m["version"]), expected), "datasets")
        return self._commit(lambda now: now | {"datasets": [*now["datasets"], folder]})

    def datasets(self, version: int | None = None) -> DataFrame:
        """All frozen examples; of a span that two writers froze at once the first."""
        own = self.manifest(version)["datasets"]
        if not own:
            return self.spark.createDataFrame([], DATASETS)
        return self.spark.read.schema(DATASETS).parquet(*(f"{self.path}/{f}" for f in own)).dropDuplicates(["name", "trace_id", "span_id"])

    # maintenance

    def _merge(self, segments: list[int], tries: int = 5) -> int:
        """The live rows of some segments as one of the next level; patches stay. Starts again if the store changes meanwhile."""
        for _ in range(tries):
            m = self.manifest()
            own = [x for x in m["segments"] if x["id"] in segments]
            if not own or (len(own) < 2 and not m["tombstones"] and own[0]["state"] == "sealed"):
                return m["version"]
            rows = self._live(m, own).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("row_idx", F.monotonically_increasing_id())
            folder = self._write(rows.select(*EVENTS.names, "row_idx", "lsn"), "segments")
            try:
                return self._add_segment(folder, 1 + max(x["level"] for x in own), instead=[x["id"] for x in own], expect=m["version"])
            except InterruptedError:
                self.files.delete(folder)
        raise RuntimeError("the store kept changing")

    def compact(self, tries: int = 5) -> int:
        """All live rows into one segment of the next level."""
        return self._merge([x["id"] for x in self.manifest()["segments"]], tries)

    def vacuum(self, retain: int = 1, pinned: list[int] = ()) -> list[str]:
        """Deletes rows that none of the last ``retain`` versions and the pinned ones names, and the older manifests."""
        versions = self.versions()
        keep = sorted({*versions[-max(1, retain) :], *pinned})
        named = set()
        for v in keep:
            m = self.manifest(v)
            named |= set(folders(m))
        gone = [f"{kind}/{n}" for kind in ("segments", "patches", "tombstones", "embeddings", "datasets", "postings", "vectors") for n in self.files.names(kind) if f"{kind}/{n}" not in named]
        for folder in gone:
            self.files.delete(folder)
        for v in versions:
            if v not in keep:
                self.files.delete(f"manifest/v{v:012d}.json")
        return gone

    def backup(self, target: str, version: int | None = None) -> int:
        """Copies what one version names to another root, which is then a store of its own."""
        m = self.manifest(version)
        for folder in folders(m):
            self.files.copy_to(folder, target)
        self.files.copy_to(f"manifest/v{m['version']:012d}.json", target)
        return m["version"]

    def metrics(self) -> dict[str, int]:
        """Numbers of the last version, without a scan."""
        m, named = self.manifest(), set()
        for v in self.versions():
            named |= set(folders(self.manifest(v)))
        live = [x for x in m["segments"] if x["state"] == "live"]
        return {
            "manifest_version": m["version"], "format_version": m["format"], "segments": len(m["segments"]), "segments_live": len(live), "live_rows": sum(x["rows"] for x in live), "rows": sum(x["rows"] for x in m["segments"]),
            "segments_dead": sum(f"segments/{n}" not in set(folders(m)) for n in self.files.names("segments")), "folders_unreferenced": sum(f"segments/{n}" not in named for n in self.files.names("segments")),
            "retained_versions": len(self.versions()), "committed_tail": m["next_seq"] - 1, "flush_threshold": self.flush_rows, "max_level": max((x["level"] for x in m["segments"]), default=0),
            "patch_batches": len(m["patches"]), "tombstone_batches": len(m["tombstones"]), "embedding_batches": len(m["embeddings"]), "dataset_batches": len(m["datasets"]), "text_batches": len(m["text"]["folders"]) if m["text"] else 0, "text_documents": m["text"]["n"] if m["text"] else 0, "next_segment": m["next_segment"],
        }

    def prometheus(self) -> str:
        """The metrics in the text format of Prometheus."""
        return "".join(f"# TYPE spanloom_{k} {'counter' if k == 'committed_tail' else 'gauge'}\nspanloom_{k} {v}\n" for k, v in self.metrics().items())
