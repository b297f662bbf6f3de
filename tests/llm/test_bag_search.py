import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quizlake.llm import bag_search
from tests.llm.conftest import SCHEMA, rows, words

ITEMS = "item_id long, text string, doc int, term string, class long"


def terms(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(pairs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in pairs]
    docs = [(i, bag, sum(bag.values())) for i, bag in docs if bag]
    total, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, bag, _ in docs for t in bag)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for item, bag in asked.items():
        found = []
        for i, doc, n in docs:
            m = 75 + 25 * n * total // length
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * doc[t] // (1000 * doc[t] + 12 * m)) for t, q in bag.items() if t in doc)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out)


def result(spark, pairs, items, parts=5, **options):
    docs = spark.createDataFrame(rows(pairs), SCHEMA).repartition(parts)
    found = bag_search.search(docs, spark.createDataFrame([(*i, 1, "x", 2) for i in items], ITEMS), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    pairs = [(i, " ".join(words(i, rng.randrange(1, 90), 60))) for i in range(300)]
    pairs += [(1000 + i, "The Same-text, w1x w2x É中 " * 3) for i in range(120)] + [(2000 + i, "w3x w3x w4x") for i in range(50)]
    pairs += [(5, None), (6, ""), (7, " .,- "), (None, "w5x w6x"), (None, "w5x w6x"), (8, "w5x w6x"), (8, "w5x w6x"), (9, " ".join(words(3, 40_000, 50)))]
    items = [(i, " ".join(words(900 + i, 12, 70))) for i in range(25)]
    items += [(50, "same É中 W1X"), (51, "w5x w6x"), (51, "w5x w6x"), (52, None), (53, "unheard of"), (None, "w1x"), (54, "w3x " * 30 + "w4x"), (55, "_.")]
    return pairs, items


def test_against_brute_force(spark, corpus):
    want = brute(*corpus)
    assert result(spark, *corpus) == want
    assert result(spark, *corpus, parts=1) == want


def test_rounds_and_narrow_matrices_change_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(bag_search, "_CELLS", 40)
    assert result(spark, *corpus, most_terms=70, k=3) == brute(*corpus, k=3)


def test_blocks_of_weights_cover_all_items(monkeypatch):
    monkeypatch.setattr(bag_search, "_CELLS", 10)
    rng = np.random.default_rng(1)
    items, terms_ = rng.integers(0, 9, 60), rng.integers(0, 30, 60)
    weights = bag_search.Weights(items, terms_, np.full(60, 10**9), 30)
    assert weights.kind is np.int64
    got = np.zeros((9, 30), np.int64)
    for first, last, column, matrix in weights.matrices():
        for term in np.flatnonzero(column >= 0):
            got[weights.names[first:last], term] += matrix[column[term]]
    assert (got > 0).sum() == len(set(zip(items.tolist(), terms_.tolist())))


def test_odd_and_empty_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, "one two é", 1, "x", 2)], ITEMS)
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in bag_search.search(odd, items).collect()) == brute(pairs, [(1, "one two é")])
    assert bag_search.search(nothing, items).collect() == []
    assert bag_search.search(odd, items.where("item_id > 1")).collect() == []
