"""Exact top-k by inner product: branch and bound over a ball tree per shard.

A node's vectors lie within a radius of its centre, so no inner product with q exceeds
q.centre + |q| radius. Nodes are visited in descending order of that bound until it falls below the
k-th best score known. That score is shared: a first pass looks into each shard's most promising
leaf alone, and the k-th best of all shards' leaves is where every shard starts in the second pass.

Vectors are compared as integers, floor(scale * x). Defined results: vectors that are null or hold a
null or non-finite component take no part; ties go to the smaller id; fewer than k candidates are all
returned; a query never meets rows of its own id; rows that repeat another id are candidates each; vectors
of different lengths do not meet; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.llm import vectors as V
from quizlake.session import materialise

#: Vectors in a leaf.
LEAF = 128


def build(ids: np.ndarray, points: np.ndarray) -> bytes:
    """Flat arrays of a tree: ids and points by leaf, per node its range, children, centre and radius."""
    order = np.arange(len(points))
    ranges, children, centres, radii = [], [], [], []

    def node(start: int, end: int) -> int:
        mine = len(ranges)
        own = points[order[start:end]]
        centre = own.mean(axis=0)
        distance = np.sqrt(((own - centre) ** 2).sum(axis=1))
        ranges.append((start, end))
        children.append((-1, -1))
        centres.append(centre)
        radii.append(float(distance.max()) * (1 + 1e-9))
        if end - start > LEAF and radii[mine] > 0:
            far = own[distance.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = own @ (other - far)
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argsort(side, kind="stable")]
            children[mine] = (node(start, start + middle), node(start + middle, end))
        return mine

    node(0, len(points))
    return V.pack_arrays(ids[order], points[order], np.array(ranges), np.array(children), np.array(centres), np.array(radii))


def search(tree: list[np.ndarray], query_id: int, query: np.ndarray, k: int, floor: float, leaves: int | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard with scores of ``floor`` and more; ``leaves`` ends it early."""
    ids, points, ranges, children, centres, radii = tree
    bounds = centres @ query + radii * np.sqrt(query @ query)
    bounds += 1e-9 * (1 + np.abs(bounds))
    waiting = [(-float(bounds[0]), 0)]
    found: list[tuple[int, int]] = []  # a heap of (score, -id): its head is the k-th best
    least = floor
    while waiting:
        bound, at = heapq.heappop(waiting)
        if -bound < least:
            break
        if children[at, 0] >= 0:
            for child in children[at].tolist():
                if bounds[child] >= least:
                    heapq.heappush(waiting, (-float(bounds[child]), child))
            continue
        start, end = ranges[at].tolist()
        scores = points[start:end] @ query
        for i in np.flatnonzero(scores >= least).tolist():
            entry = (int(scores[i]), -int(ids[start + i]))
            if -entry[1] == query_id:
                continue
            if len(found) < k:
                heapq.heappush(found, entry)
            elif entry > found[0]:
                heapq.heapreplace(found, entry)
        if len(found) == k:
            least = max(least, found[0][0])
        if leaves is not None:
            leaves -= 1
            if not leaves:
                break
    return [(score, -i) for score, i in found]


def _search_rows(batches: Iterator[pa.RecordBatch], k: int, first: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            tree = V.unpack_arrays(batch.column("index")[row].as_buffer())
            asked, queries = V.unpack_arrays(batch.column("queries")[row].as_buffer())
            floors = dict(zip(batch.column("known")[row].as_py() or [], batch.column("floors")[row].as_py() or []))
            largest = max(np.abs(tree[1]).max(), np.abs(queries).max(), 1)
            if largest * largest * queries.shape[1] >= 2**53:  # beyond what doubles count exactly
                tree[1], queries = tree[1].astype(np.int64), queries.astype(np.int64)
            out = [
                (q, i, s)
                for q, v in zip(asked.tolist(), queries)
                for s, i in search(tree, q, v, k, floors.get(q, float("-inf")), 1 if first else None)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id and integer score of the k best for every row that ``queries`` (over
    ``id``) selects."""
    rows = V.usable(vectors, key, vector, nonzero=False).withColumn("v", F.transform("v", lambda e: F.floor(e * scale).cast("double")))
    index, blocks = V.index_and_queries(rows, queries, build, "ball_tree")
    blocks = materialise(blocks, "queries")
    found = "query_id long, vec_id long, score long"
    nothing = [F.lit(None).cast("array<long>").alias("known"), F.lit(None).cast("array<double>").alias("floors")]
    leaf = V.meet(index, blocks.select("*", *nothing)).mapInArrow(lambda b: _search_rows(b, k, True), found)
    kth = V.best(leaf, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    return V.best(_second(index, blocks, kth, k, found), k)


def _second(index: DataFrame, blocks: DataFrame, floors: DataFrame, k: int, found: str) -> DataFrame:
    """The full search of all shards, from the scores known so far."""
    members = blocks.mapInArrow(_members, "dim int, number long, id long")
    known = members.join(floors.withColumnRenamed("query_id", "id"), "id").groupBy("dim", "number").agg(
        F.collect_list(F.struct("id", "floor")).alias("pairs")
    ).select("dim", "number", F.col("pairs.id").alias("known"), F.col("pairs.floor").alias("floors"))
    return V.meet(index, blocks.join(known, ["dim", "number"], "left")).mapInArrow(lambda b: _search_rows(b, k, False), found)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            ids = V.unpack_arrays(batch.column("packed")[row].as_buffer())[0]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("dim")[row].as_py()] * n, pa.int32()), pa.array([batch.column("number")[row].as_py()] * n, pa.int64()), pa.array(ids)],
                ["dim", "number", "id"],
            )
