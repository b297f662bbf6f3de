"""Shared by the operators of this subpackage: input tables, Arrow columns and vocabulary files."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Plans that run inside hand at most ``rows`` rows at once to Python: long texts beside each other
    then take little memory on both sides. The session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hand_back() -> None:
    """Free memory of this process goes back to the machine: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on whichever machine asks."""
    return public_tokenizers.path(name)


def text_bytes(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The UTF-8 bytes of an Arrow string column, null as empty, and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = memoryview(offsets).cast("q")[column.offset : column.offset + len(column) + 1].tolist()
    return memoryview(data or b""), bounds
