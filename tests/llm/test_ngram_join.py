import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from quizlake.llm.components import connected_components
from quizlake.llm.ngram_join import BLOCK, InvertedLists, jaccard_components, search_block
from tests.llm.conftest import SCHEMA, edited, rows, words


def shingles(text, k=5):
    w = [x.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def brute(pairs, percent=75):
    sets = [(i, shingles(t)) for i, t in pairs]
    parent = {i: i for i, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i)) for i, s in sets)


def result(df, **options):
    return Counter((r[0], r[1], r[2]) for r in jaccard_components(df, **options).collect())


def test_odd_rows(odd):
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute([p for p in pairs if p[0] is not None])
    lone = next(len(shingles(t)) for i, t in pairs if i is None)
    assert result(odd) == want + Counter([(None, lone, None)])


def test_empty_table(nothing):
    assert jaccard_components(nothing).collect() == []


def test_large_group_of_near_copies_is_split_and_whole(spark):
    rng, base = random.Random(5), words(2, 110)
    pairs = [(i, " ".join(edited(base, i, rng.randrange(1, 5)))) for i in range(3 * BLOCK)]
    passage = words(4, 60)
    pairs += [(1000 + i, " ".join(words(50 + i, 25) + passage)) for i in range(60)]
    pairs += [(2000 + i, " ".join(words(500 + i // 2, 40)) + (" tail" if i % 2 else "")) for i in range(40)]
    pairs += [(3000 + i, pairs[0][1]) for i in range(30)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    want = brute(pairs)
    assert result(df.repartition(7)) == want
    assert result(df.coalesce(1)) == want


def test_partitions_without_a_counted_shingle(spark):
    blank = spark.createDataFrame(rows([(1, None), (2, "")]), SCHEMA).coalesce(1)
    assert result(blank) == Counter([(1, 0, 1), (2, 0, 2)])
    pairs = [(i, f"one two {i // 2}") for i in range(40)] + [(100 + i, None) for i in range(5)]
    assert result(spark.createDataFrame(rows(pairs), SCHEMA).repartition(60)) == brute(pairs)


@pytest.mark.parametrize("percent", [50, 60, 74, 90])
def test_other_thresholds_and_sets_of_few_shingles(spark, percent):
    rng = random.Random(percent)
    pairs = [(i, " ".join(words(i % 9, rng.randrange(5, 12), 6))) for i in range(120)]
    pairs += [(200 + i, " ".join(words(70 + i // 6, 40)[: 5 + i % 6])) for i in range(60)]
    assert result(spark.createDataFrame(rows(pairs), SCHEMA).repartition(5), percent=percent) == brute(pairs, percent)


def test_both_texts_of_a_repeated_key_keep_their_links(spark):
    a, b = words(1, 60), words(2, 60)
    near = [edited(a, 5, 1), edited(b, 6, 1)]
    pairs = [(5, " ".join(a)), (5, " ".join(b)), (8, " ".join(near[0])), (9, " ".join(near[1])), (12, " ".join(words(3, 60)))]
    df = spark.createDataFrame(rows(pairs), SCHEMA)
    for parts in (1, 4):
        assert {(r[0], r[2]) for r in jaccard_components(df.repartition(parts)).collect()} == {(5, 5), (8, 5), (9, 5), (12, 12)}


def test_a_repeated_key_ties_its_texts(spark):
    a, b = " ".join(words(1, 30)), " ".join(words(2, 30))
    df = spark.createDataFrame(rows([(5, a), (5, b), (3, a), (9, b)]), SCHEMA)
    assert {r[2] for r in jaccard_components(df).collect()} == {3}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=12), st.integers(50, 100))
def test_t_occurrence_search_finds_exactly_the_similar(sets, percent):
    held = [np.array(sorted(s), np.int64) for s in sets]
    index = InvertedLists(held)
    for i, q in enumerate(held):
        want = {j for j, s in enumerate(sets) if 100 * len(sets[i] & s) >= percent * len(sets[i] | s)}
        assert set(index.search(q, percent, lambda _: True)) == want


def test_visitors_meet_members_only():
    same = np.arange(10)
    found = search_block([1, 2, 3], [same, same + 100, same], [1, 2, 3], [False, True, True], 75)
    assert found == [(3, 1)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 260)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 200 for i in range(200, 260)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bounds_of_the_threshold(nothing):
    with pytest.raises(ValueError):
        jaccard_components(nothing, percent=40)


def test_texts_go_to_python_in_small_batches_and_leave_no_shuffle_files(spark, monkeypatch):
    from quizlake.llm import ngram_join

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before, seen = [spark.conf.get(n) for n in names], []
    inner = ngram_join._components
    monkeypatch.setattr(ngram_join, "_components", lambda *a: (seen.append(int(spark.conf.get(names[0]))), inner(*a))[1])
    ngram_join.jaccard_components(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"))
    assert seen == [ngram_join.BATCH] and [spark.conf.get(n) for n in names] == before
