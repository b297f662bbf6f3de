import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlake.llm import ball_tree, hnsw
from quizlake.llm import vectors as V
from quizlake.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], 1, "x") for i in range(120)]
    rows += [(200 + i, [0.5] * 6, 1, "x") for i in range(30)]  # equal vectors tie
    rows += [(300, None, 1, "x"), (320, [], 1, "x"), (340, [1.0, None] + [0.0] * 4, 1, "x"), (360, [NAN] * 6, 1, "x"), (380, [INF] * 6, 1, "x"), (400, [0.0] * 6, 1, "x")]
    rows += [(None, [1.0] * 6, 1, "x"), (40, [3.0] * 6, 1, "x"), (500, [1.0, 2.0], 1, "x"), (520, [2.0, 1.0], 1, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, v string")


def exact(df, k, score, zero):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect() if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and (zero or v.any())]
    out = {}
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        mine = min(tuple(v) for i, v in rows if i == q)
        found = sorted((-score(np.array(mine), v), i) for i, v in rows if i != q and len(v) == len(mine))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_ball_tree_is_exact(odd_vectors):
    want = exact(odd_vectors, 7, lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)), True)
    for parts in (1, 6):
        got = results(ball_tree.top_k(odd_vectors.repartition(parts), F.col("id") % 20 == 0, k=7))
        assert got == {q: r for q, r in want.items() if r}


def test_search_in_many_shards(spark, folder, monkeypatch):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    want = exact(rows, 20, lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)), True)
    index = V.index_and_queries
    monkeypatch.setattr(V, "index_and_queries", lambda *a: index(*a, shard=60, block=7))
    assert results(ball_tree.top_k(rows, F.col("id") % 20 == 0, k=20)) == want
    near = exact(rows, 20, lambda a, b: float((a * b).sum()), False)
    got = results(hnsw.nearest(rows, F.col("id") % 20 == 0, k=20))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in near[q]}) / 20 for q in near]) >= 0.95


def test_recall_in_one_large_shard():
    points = np.random.default_rng(1).normal(size=(3000, 24))
    points[100:400] = points[100]  # a vector of many copies
    points *= np.random.default_rng(2).uniform(0.2, 3, (3000, 1))
    ids = np.arange(3000)
    asked = ids[::20]
    found = {}
    for q, i, s in hnsw.search(V.unpack_arrays(hnsw.build(ids, points)), asked, points[asked], 20, hnsw.SEARCH_BEAM):
        assert s == pytest.approx(points[q] @ points[i])
        found.setdefault(q, set()).add(i)
    recall = []
    for q in asked.tolist():
        order = sorted((-(points[q] @ points[i]), i) for i in ids.tolist() if i != q)[:20]
        recall.append(len({i for _, i in order} & found[q]) / 20)
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("longer,how_many", [(1, 1), (100, 1), (10_000, 1), (1e6, 1), (1e6, 200), (30, 1500)])
def test_recall_beside_longer_vectors(longer, how_many):
    rng = np.random.default_rng(int(longer) + how_many)
    centres = rng.normal(size=(40, 32))
    points = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 32))
    points[rng.choice(3000, how_many, replace=False)] *= longer
    asked = np.arange(0, 3000, 20)
    found = {}
    for q, i, s in hnsw.search(V.unpack_arrays(hnsw.build(np.arange(3000), points)), asked, points[asked], 20, hnsw.SEARCH_BEAM):
        found.setdefault(q, set()).add(i)
    scores = points[asked] @ points.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(found[q] & set(w)) / 20 for q, w in zip(asked.tolist(), want.tolist())]) >= 0.9


def test_recall_of_lengths_over_six_powers():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(3000, 24)) * 10 ** rng.uniform(0, 6, (3000, 1))
    asked = np.arange(0, 3000, 30)
    found = {}
    for q, i, s in hnsw.search(V.unpack_arrays(hnsw.build(np.arange(3000), points)), asked, points[asked], 20, hnsw.SEARCH_BEAM):
        found.setdefault(q, set()).add(i)
    scores = points[asked] @ points.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(found[q] & set(w)) / 20 for q, w in zip(asked.tolist(), want.tolist())]) >= 0.9


def test_hnsw_of_odd_vectors(odd_vectors):
    want = exact(odd_vectors, 7, lambda a, b: float((a * b).sum()), False)
    got = results(hnsw.nearest(odd_vectors, F.col("id") % 20 == 0, k=7))
    assert got.keys() == {q for q, r in want.items() if r}
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in got]) >= 0.95
    assert got[200] == [(i, s) for i, s in want[200]]


def test_empty_tables(odd_vectors):
    none = odd_vectors.where("vec_id < 0")
    assert ball_tree.top_k(none, F.col("id") % 20 == 0).collect() == []
    assert hnsw.nearest(none, F.col("id") % 20 == 0).collect() == []


def test_arrays_survive_packing():
    arrays = [np.arange(5), np.zeros((2, 0)), np.ones((3, 2), np.float32), np.array([[1, 2]], np.int32)]
    for a, b in zip(arrays, V.unpack_arrays(V.pack_arrays(*arrays))):
        assert a.dtype == b.dtype and a.shape == b.shape and (a == b).all()


def test_recall_of_the_query(spark, folder):
    near = exact(spark.read.parquet(f"{folder}/embeddings.parquet"), 20, lambda a, b: float((a * b).sum()), False)
    got = results(QUERIES["op9_hnsw"].plan(spark, folder))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in near[q]}) / 20 for q in near]) >= 0.9
