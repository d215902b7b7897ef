"""Delta-maintained rollups of token counts by source, language and tokenizer version.

Changes are signed rows (source, lang, tokenizer, docs, tokens): an insert adds a document and its tokens, a delete takes
them away, a revised count is the delete of the old row and the insert of the new one. A batch is summed by key, written
to a folder of its own attempt and committed by publishing one marker file, named by the batch and holding the attempt. A
marker appears whole or not at all and can appear once: a batch that is committed again, retried or run twice at once
counts once, and an attempt without a marker counts never. A file that isn't a marker, such as the torn one of a writer
that died, counts as none, and the next commit of its batch replaces it. Totals are the sums over committed batches; nothing is rewritten or read back to update
them. ``compact`` sums them into a numbered base file, whose creation
switches all readers at once; batches keep their markers.

Results for odd input: null or empty text has 0 tokens and counts as a document; null source or lang is a key of its own;
repeated rows count each; an empty batch commits and changes nothing; keys whose documents and tokens have both come to 0
are left out; extra columns are ignored. A very long text is counted in pieces cut where the tokenizers cut anyway, before a
space between two other characters; a long run of blanks is a piece of its own, but for its last character.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.files import Files

TOKENIZERS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: How both vocabularies cut a text before merging bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 100_000
KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"

_loaded: dict = {}
_cut = re.compile(r"(?<=[^\s]) (?=[^\s])")
_blanks = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def encoder(path: str, content: bytes | None = None):
    """The tokenizer of a vocabulary file, or of the file's content, which is known by ``path`` then."""
    if path not in _loaded:
        import tiktoken

        if content is None:
            with open(path, "rb") as f:
                content = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def pieces(text: str, size: int = PIECE):
    start = 0
    while len(text) - start > size:
        m = _cut.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def count(text: str | None, path: str) -> int:
    if not text:
        return 0
    own, n, start = encoder(path), 0, 0
    for m in _blanks.finditer(text):
        # PATTERN takes a run of blanks up to the last, which goes with what follows.
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += sum(len(own.encode_ordinary(p)) for p in pieces(text[start : m.start()]))
        n += len(own._encode_single_piece(text[m.start() : end].encode()))
        start = end
    return n + sum(len(own.encode_ordinary(p)) for p in pieces(text[start:]))


def _sent(spark: SparkSession, tokenizers: dict[str, str]):
    """The vocabularies, read by the driver: executors need no such files."""
    out = {}
    for name, path in tokenizers.items():
        with open(path, "rb") as f:
            out[name] = (path, f.read())
    return spark.sparkContext.broadcast(out)


def _counter(tokenizers, text_at: tuple[int, ...]):
    """Rows of source, lang, doc_id and tokenizer with the count of each text column."""

    def run(batches):
        for b in batches:
            texts = [b.column(c).to_pylist() for c in text_at]
            for name, (path, content) in tokenizers.value.items():
                encoder(path, content)
                counts = [pa.array(np.array([count(t, path) for t in column], np.int64)) for column in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([name] * b.num_rows, pa.string()), *counts], ["doc_id", "source", "lang", "tokenizer", *(f"n{k}" for k in range(len(counts)))])

    return run


def _keys(docs: DataFrame) -> list:
    return ["doc_id", *(F.col(c).cast("string").alias(c) for c in ("source", "lang"))]


def token_counts(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """doc_id, source, lang, tokenizer, n0: the tokens of each document under each tokenizer."""
    return docs.select(*_keys(docs), "text").mapInArrow(_counter(_sent(docs.sparkSession, tokenizers), (3,)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, tokenizer string, n0 long")


def revised_counts(docs: DataFrame, new_text, tokenizers: dict[str, str] = TOKENIZERS) -> DataFrame:
    """As token_counts, with n0 of the old text and n1 of ``new_text`` (a Column)."""
    return docs.select(*_keys(docs), "text", new_text.alias("__ll_new")).mapInArrow(_counter(_sent(docs.sparkSession, tokenizers), (3, 4)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, tokenizer string, n0 long, n1 long")


def inserts(counts: DataFrame, n: str = "n0") -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col(n).alias("tokens"))


def deletes(counts: DataFrame, n: str = "n0") -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col(n)).alias("tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """The old count (n0) goes, the new one (n1) comes."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("n1") - F.col("n0")).alias("tokens"))


def _marker(text: str) -> dict | None:
    """What a marker says; None for a file that isn't one."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and "attempt" in found else None


class RollupStore:
    """Committed batches of summed deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    def _read(self, folder: str) -> list[dict]:
        names = self.files.names(folder)
        if not any(not n.startswith((".", "_")) for n in names):
            return []
        rows = self.spark.read.text(f"{self.path}/{folder}", wholetext=True).collect()
        return [x for x in (_marker(r[0]) for r in rows) if x]

    def _attempts(self) -> tuple[list[str], list[str], int]:
        """Folders whose rows count, the committed batches, and the number of the last base."""
        commits = {x["batch"]: x["attempt"] for x in self._read("commits")}
        base = max(self._read("bases"), key=lambda x: x["number"], default={"number": 0, "batches": []})
        summed = set(base["batches"])
        folders = {a for x, a in commits.items() if x not in summed} | {base[k] for k in base if k == "attempt"}
        return sorted(folders), sorted(commits), base["number"]

    def _at(self, batch: str) -> str:
        return f"commits/{quote(batch, safe='')}"

    def committed(self, batch: str) -> bool:
        return self.files.exists(self._at(batch)) and _marker(self.files.read(self._at(batch))) is not None

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch. False, and nothing done, if it is committed already."""
        if self.committed(batch):
            return False
        if self.files.exists(self._at(batch)):
            self.files.delete(self._at(batch))
        attempt = f"rows/{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.parquet(f"{self.path}/{attempt}")
        return self.files.publish(self._at(batch), json.dumps({"batch": batch, "attempt": attempt}))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens."""
        return self._totals(self._attempts()[0])

    def _totals(self, attempts: list[str]) -> DataFrame:
        if not attempts:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/{a}" for a in attempts))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Sums the committed batches into a numbered base, which counts instead of them. False if another run made that base."""
        folders, batches, number = self._attempts()
        attempt = f"rows/{uuid.uuid4().hex}"
        self._totals(folders).coalesce(1).write.parquet(f"{self.path}/{attempt}")
        return self.files.publish(f"bases/{number + 1}", json.dumps({"number": number + 1, "attempt": attempt, "batches": batches}))
