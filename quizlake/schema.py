"""Declared schemas. Nothing in the package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()

ITEM = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("question", _TEXT),
        T.StructField("options", T.ArrayType(_TEXT)),
        T.StructField("correct", _TEXT),
        T.StructField("rationale", _TEXT),
    ]
)

NUMERIC_ITEM = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("question", _TEXT),
        T.StructField("answer", _TEXT),
    ]
)

_REPLY = [
    T.StructField("LLMs_rationale", _TEXT),
    T.StructField("LLMs_answer", _TEXT),
    T.StructField("status", _TEXT),
    T.StructField("error", _TEXT),
    T.StructField("attempts", T.LongType()),
]
REPLY_NAMES = [field.name for field in _REPLY]

RESULTS = {
    "mcq": T.StructType(ITEM.fields[:4] + _REPLY),
    "numeric": T.StructType(NUMERIC_ITEM.fields + _REPLY),
}

RUN_CSV = T.StructType(
    [
        T.StructField("question", _TEXT),
        T.StructField("options", _TEXT),
        T.StructField("correct", _TEXT),
        T.StructField("llm_answer", _TEXT),
        T.StructField("few_shot_prompt", _TEXT),
    ]
)

REPLIES = T.StructType(
    [
        T.StructField("response", _TEXT),
        T.StructField("error", _TEXT),
        T.StructField("attempts", T.LongType()),
    ]
)


def results_schema(kind: str) -> T.StructType:
    """Schema of a result table: ``mcq`` or ``numeric``."""
    if kind not in RESULTS:
        raise ValueError(f"kind must be one of {sorted(RESULTS)}, not {kind!r}")
    return RESULTS[kind]
