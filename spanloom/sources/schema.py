"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()

#: Values that a fold keeps the last non-null of, in column order.
FOLDED = {
    "status": T.ShortType(), "duration_ns": _L, "parent_span_id": _L, "input_tokens": _L, "output_tokens": _L, "session_id": _L, "tenant_id": _L,
    "agent_name": _S, "tool_name": _S, "model": _S, "input_text": _S, "output_text": _S, "eval_score": _I, "eval_label": _S,
}
IDENTITY = {"trace_id": _L, "span_id": _L, "ts": _L, "seq": _L, "event_type": T.ShortType(), "ext_span_id": _S}
LOGS = T.ArrayType(_S)


def _struct(fields: dict) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVENTS = _struct({**IDENTITY, **FOLDED, "logs": LOGS})
#: With the place of the event: scan order is segments before the live tail, then row.
STORED = _struct({**IDENTITY, **FOLDED, "logs": LOGS, "segment_id": _L, "row_idx": _L, "lsn": _L})
PATCHES = _struct({"trace_id": _L, "span_id": _L, "segment_id": _L, "patch_seq": _L, **FOLDED, "logs": LOGS})
TOMBSTONES = _struct({"segment_id": _L, "row_idx": _L, "deletion_seq": _L})
EMBEDDINGS = _struct({"trace_id": _L, "span_id": _L, "embedding": T.ArrayType(T.FloatType()), "lsn": _L})
DATASETS = _struct({"name": _S, "trace_id": _L, "span_id": _L, **FOLDED, "logs": LOGS, "event_count": _L, "expected": _S})
