"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

A shard's graph is a stack of layers over its distinct vectors. Each layer is one flat array of
neighbours, -1 where there are fewer. A search descends greedily through the upper layers and keeps a
beam of the best nodes on the lowest; all queries of a block step together, so a step is a few numpy
calls whatever the number of queries. Nodes enter in batches by the same search. Inner products are
made distances of a sphere by one more component, which lifts every vector to the same length.

What the beams of all shards hold is scored again on the original vectors in double precision and
ranked per query. Defined results: vectors that are null, zero or hold a null or non-finite component
take no part; ties go to the smaller id; fewer than k candidates are all returned where a beam
reaches them; a query never meets rows of its own id; equal vectors share a node and are all found
with it; vectors of different lengths do not meet; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from quizlake.llm import vectors as V

#: Lengths within one graph differ by this factor at most.
BAND = 4.0
#: Neighbours a node is given, beam while building, beam while searching, nodes entered at once.
DEGREE, BUILD_BEAM, SEARCH_BEAM, BATCH = 16, 96, 128, 128
#: Nodes a query opens in one step.
OPENED = 4


def beam_search(points: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best nodes (queries, beam) and their similarities, descending; -1 where fewer were met.

    ``neighbours`` has a row per node of ``points``; ``entries`` a start node per query.
    """
    n = len(queries)
    rows = np.arange(n)
    nodes = np.full((n, beam), -1, np.int64)
    scores = np.full((n, beam), -np.inf, np.float32)
    opened = np.ones((n, beam), bool)
    nodes[:, 0] = entries
    scores[:, 0] = np.einsum("qd,qd->q", points[entries], queries)
    opened[:, 0] = False
    seen = np.zeros((n, len(points) + 1), bool)  # the last place takes what is no node
    seen[rows, entries] = True
    active = rows
    while len(active):
        waiting = np.where(opened[active], -np.inf, scores[active])
        pick = np.argsort(-waiting, axis=1, kind="stable")[:, : min(OPENED, beam)]
        valid = np.take_along_axis(waiting, pick, axis=1) > -np.inf
        going = valid.any(axis=1)
        active, pick, valid = active[going], pick[going], valid[going]
        if not len(active):
            break
        here = np.take_along_axis(nodes[active], pick, axis=1)
        opened[active[:, None], pick] = True
        reached = np.where(valid[:, :, None], neighbours[here], -1).reshape(len(active), -1)
        fresh = (reached >= 0) & ~seen[active[:, None], reached]
        # A node that two opened nodes lead to counts once: sort, and drop what repeats.
        reached = np.sort(np.where(fresh, reached, -1), axis=1)
        fresh = (reached >= 0) & np.concatenate([np.ones((len(active), 1), bool), reached[:, 1:] != reached[:, :-1]], axis=1)
        reached = np.where(fresh, reached, -1)
        seen[active[:, None], reached] = True
        found = np.einsum("qmd,qd->qm", points[reached], queries[active])
        found[~fresh] = -np.inf
        together = np.concatenate([scores[active], found], axis=1)
        order = np.argsort(-together, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], reached], axis=1), order, axis=1)
        scores[active] = np.take_along_axis(together, order, axis=1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], ~fresh], axis=1), order, axis=1)
    return nodes, scores


def spread_out(points: np.ndarray, candidates: np.ndarray, similar: np.ndarray, degree: int) -> list[int]:
    """Of candidates by descending similarity, those nearer to the new node than to one chosen
    already; places left go to the nearest of the rest."""
    gram = points[candidates] @ points[candidates].T
    chosen: list[int] = []
    passed: list[int] = []
    for i in range(len(candidates)):
        if len(chosen) == degree:
            break
        if not chosen or similar[i] >= gram[i, chosen].max():
            chosen.append(i)
        else:
            passed.append(i)
    chosen += passed[: degree - len(chosen)]
    return [int(candidates[i]) for i in chosen]


class Layer:
    """One layer while it grows: neighbours and their similarities, worst ones giving way."""

    def __init__(self, nodes: int, degree: int):
        self.ids = np.full((nodes + 1, degree), -1, np.int64)
        self.similar = np.full((nodes + 1, degree), -np.inf, np.float32)

    def link(self, a: int, b: int, similarity: float) -> None:
        place = int(self.similar[a].argmin())
        if similarity > self.similar[a, place] and b not in self.ids[a]:
            self.ids[a, place], self.similar[a, place] = b, similarity


def build_graph(points: np.ndarray, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    """Entry path (one start node per layer, top first) and the layers' neighbour arrays, top first."""
    n = len(points)
    rng = np.random.default_rng(seed)
    top = np.minimum((-np.log(rng.random(n)) / np.log(DEGREE)).astype(np.int64), 8)
    # The first node of the highest level is the entry of all.
    order = np.concatenate([[top.argmax()], np.delete(np.arange(n), top.argmax())])
    layers = [Layer(n, 2 * DEGREE if level == 0 else DEGREE) for level in range(int(top.max()) + 1)]
    padded = np.concatenate([points, np.zeros((1, points.shape[1]), points.dtype)])
    entry, done = int(order[0]), 1
    while done < n:
        batch = order[done : done + min(BATCH, done)]
        done += len(batch)
        queries = points[batch]
        starts = np.full(len(batch), entry)
        for level in range(len(layers) - 1, -1, -1):
            layer = layers[level]
            mine = np.flatnonzero(top[batch] >= level)
            lower = np.flatnonzero(top[batch] < level)
            if len(lower):
                starts[lower] = beam_search(padded[:n], layer.ids[:n], queries[lower], starts[lower], 1)[0][:, 0]
            if not len(mine):
                continue
            nodes, scores = beam_search(padded[:n], layer.ids[:n], queries[mine], starts[mine], BUILD_BEAM)
            starts[mine] = nodes[:, 0]
            # Nodes of one batch do not meet in the graph: they are compared with each other here.
            among = queries[mine] @ queries[mine].T
            for row, place in enumerate(mine.tolist()):
                node = int(batch[place])
                known = nodes[row][nodes[row] >= 0]
                fellows = np.argsort(-among[row], kind="stable")[: DEGREE + 1]
                fellows = fellows[fellows < row]
                candidates = np.concatenate([known, batch[mine[fellows]]])
                similar = np.concatenate([scores[row][: len(known)], among[row][fellows]])
                best = np.argsort(-similar, kind="stable")[:BUILD_BEAM]
                for other in spread_out(points, candidates[best], similar[best], DEGREE):
                    similarity = float(points[node] @ points[other])
                    layer.link(node, other, similarity)
                    layer.link(other, node, similarity)
    return np.array([entry]), [layer.ids[:n] for layer in reversed(layers)]


def build(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """Flat arrays of a shard: members by node, bounds, original vectors, and per band of lengths the
    longest length, the band's nodes, lifted points, entry and layers.

    Points are lifted to one length, which turns inner products into nearness. One far longer vector
    would take the others' differences with it, so vectors go into bands of lengths within BAND.
    """
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    bounds = np.searchsorted(node.ravel()[order], np.arange(len(distinct) + 1))
    largest = np.abs(distinct).max(axis=1)
    lengths = np.sqrt(((distinct / largest[:, None]) ** 2).sum(axis=1)) * largest
    band = np.floor(np.log(lengths.max() / lengths) / np.log(BAND)).astype(np.int64)
    parts, sizes = [], []
    for b in np.unique(band).tolist():
        mine = np.flatnonzero(band == b)
        top = lengths[mine].max()
        scaled = distinct[mine] / top
        lift = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))
        points = np.column_stack([scaled, lift]).astype(np.float32)
        entry, layers = build_graph(points)
        arrays = [np.array([top]), mine, points, entry, *[layer.astype(np.int32) for layer in layers]]
        parts += arrays
        sizes.append(len(arrays))
    return V.pack_arrays(ids[order], bounds, distinct, np.array(sizes), *parts)


def search(graph: list[np.ndarray], asked: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
    """(query id, vector id, inner product) of the k best that the beam found for each query. A band
    is searched for the queries whose k-th score its longest vector could still reach."""
    ids, bounds, distinct, sizes = graph[:4]
    largest = np.abs(queries).max(axis=1)
    norms = np.sqrt(((queries / largest[:, None]) ** 2).sum(axis=1)) * largest
    flat = np.column_stack([queries / norms[:, None], np.zeros(len(queries))]).astype(np.float32)
    best: list[list[tuple[float, int]]] = [[] for _ in asked]
    start = 4
    for size in sizes.tolist():
        top, mine, points, entry, *layers = graph[start : start + size]
        start += size
        open_ = np.array([len(rows) < k or -rows[-1][0] <= float(top[0]) * norm * (1 + 1e-9) for rows, norm in zip(best, norms.tolist())])
        some = np.flatnonzero(open_)
        if not len(some):
            break
        at = np.full(len(some), int(entry[0]))
        for layer in layers[:-1]:
            at = beam_search(points, layer, flat[some], at, 1)[0][:, 0]
        nodes, _ = beam_search(points, layers[-1], flat[some], at, max(beam, k + 1))
        for q, row in zip(some.tolist(), nodes):
            row = mine[row[row >= 0]]
            scores = (distinct[row] * queries[q]).sum(axis=1)
            rows: list[tuple[float, int]] = []
            last = -np.inf
            for i in np.argsort(-scores, kind="stable").tolist():
                if len(rows) >= k and scores[i] < last:
                    break
                members = [m for m in ids[bounds[row[i]] : bounds[row[i] + 1]][: k + 1].tolist() if m != asked[q]]
                rows += [(-float(scores[i]), m) for m in members]
                last = scores[i]
            best[q] = sorted(best[q] + rows)[:k]
    return [(q, m, -s) for q, rows in zip(asked.tolist(), best) for s, m in rows]


def _search_rows(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            graph = V.unpack_arrays(batch.column("index")[row].as_buffer())
            out = search(graph, *V.unpack_arrays(batch.column("queries")[row].as_buffer()), k, beam)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.float64()])], ["query_id", "vec_id", "score"]
                )


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score (inner product) of the k nearest found for every row that
    ``queries`` (over ``id``) selects."""
    index, blocks = V.index_and_queries(V.usable(vectors, key, vector, nonzero=True), queries, build, "hnsw")
    found = V.meet(index, blocks).mapInArrow(lambda b: _search_rows(b, k, beam), "query_id long, vec_id long, score double")
    return V.best(found, k)
