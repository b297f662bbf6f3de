"""Vectors in shards: each shard's index is one row of flat arrays, each block of queries another.

A shard holds a bounded number of vectors, picked by a hash of their id, so that equal vectors and
runs of ids spread. Every block of queries meets every shard by a join on the shard's number; the
best of each shard are ranked per query at the end. Only vectors of one length meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.ngram_join import _groups as groups
from quizlake.llm.ngram_join import number_lists
from quizlake.session import materialise

#: Vectors in a shard and queries in a block.
SHARD, QUERIES = 4096, 512


def usable(vectors: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """(id, v, dim) of rows with an id and a vector without null and non-finite components."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    some = F.exists(x, lambda e: e != 0) if nonzero else F.lit(True)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fine & some)
    return rows.select(F.col(key).cast("long").alias("id"), x.alias("v"), F.size(vector).alias("dim"))


def _packed(batches: Iterator[pa.RecordBatch], keys: list[str], build: Callable[[np.ndarray, np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, keys):
        ids = group.column("id").to_numpy()
        made = build(ids, np.stack(number_lists(group.column("v"))))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([group.column(k)[0].as_py()], group.schema.field(k).type) for k in keys], pa.array([made], pa.binary())], [*keys, "packed"]
        )


def packed_groups(rows: DataFrame, number: Column, build: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """One row (dim, number, packed) for each length of vector and value of ``number``."""
    keys = ["dim", "number"]
    dealt = rows.withColumn("number", number).repartition(*keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(lambda b: _packed(b, keys, build), "dim int, number long, packed binary")


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value."""
    head = [len(arrays)]
    for a in arrays:
        head += [" bilfd".index(a.dtype.char if a.dtype.char != "q" else "l"), a.ndim, *a.shape]
    return b"".join([np.array([len(head), *head], np.int64).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, size, 8).tolist()
    at, place, out = 8 + 8 * size, 1, []
    for _ in range(head[0]):
        kind, ndim = np.dtype(" bilfd"[head[place]]), head[place + 1]
        shape = head[place + 2 : place + 2 + ndim]
        place += 2 + ndim
        count = int(np.prod(shape))
        out.append(np.frombuffer(data, kind, count, at).reshape(shape))
        at += count * kind.itemsize
    return out


def meet(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every (shard, block of queries) of one length: (index, queries and the block's other columns)."""
    there = shards.groupBy("dim").agg(F.max("number").alias("last"))
    spread = blocks.withColumnRenamed("packed", "queries").join(there, "dim")
    spread = spread.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("shard")).drop("last")
    index = shards.select(F.col("dim").alias("dim_"), F.col("number").alias("shard_"), F.col("packed").alias("index"))
    return spread.join(index, (F.col("dim") == F.col("dim_")) & (F.col("shard") == F.col("shard_"))).drop("dim_", "shard_")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score): highest score first, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def index_and_queries(
    rows: DataFrame, queries: Column, build: Callable[[np.ndarray, np.ndarray], bytes], name: str, shard: int = SHARD, block: int = QUERIES
) -> tuple[DataFrame, DataFrame]:
    """Written index rows of all vectors and packed blocks of those that ``queries`` selects."""
    rows = materialise(rows, name)
    shards, blocks = -(-rows.count() // shard), -(-rows.where(queries).count() // block)
    spread = F.xxhash64("id")
    index = materialise(packed_groups(rows, F.pmod(spread, F.lit(max(1, shards))), build), name)
    # An id that asks with several vectors asks with the least.
    asked = rows.where(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    return index, packed_groups(asked, F.pmod(spread, F.lit(max(1, blocks))), lambda ids, v: pack_arrays(ids, v))
