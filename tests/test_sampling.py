import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizlake.operators import sampling

SEED = 42


def by_hash(keys, seed=SEED):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def rows(spark):
    letter = F.char(F.lit(65) + F.col("item_id") % 7)
    return spark.range(3000).withColumnRenamed("id", "item_id").withColumn("correct", letter).cache()


def arrangements(df):
    yield df.repartition(1)
    yield df.repartition(3)
    yield df.repartition(17)
    yield df.orderBy(F.desc("item_id"))
    yield df.orderBy(F.xxhash64("item_id"))


@pytest.mark.parametrize("n", [0, 1, 13, 254, 1700, 2999, 3000, 9999])
def test_uniform_sample_is_the_lowest_hashes(rows, n):
    wanted = by_hash(range(3000))[:n]
    got = sampling.sample_uniform(rows, n, "item_id", SEED).orderBy("rank").collect()
    assert [row["item_id"] for row in got] == wanted
    assert [row["rank"] for row in got] == list(range(1, len(wanted) + 1))


def test_uniform_sample_ignores_layout(rows):
    samples = {
        tuple(r["item_id"] for r in sampling.sample_uniform(df, 100, "item_id", 7).orderBy("rank").collect())
        for df in arrangements(rows)
    }
    assert len(samples) == 1


def test_strict_sample_needs_the_rows(rows):
    with pytest.raises(ValueError, match="3001 rows wanted, 3000 there"):
        sampling.sample_uniform(rows, 3001, "item_id", SEED, strict=True)
    with pytest.raises(ValueError):
        sampling.sample_uniform(rows, -1, "item_id", SEED)


def test_full_rank_is_a_permutation(rows):
    got = {r["item_id"]: r["rank"] for r in sampling.seeded_rank(rows, "item_id", SEED).collect()}
    assert got == {key: i for i, key in enumerate(by_hash(range(3000)), 1)}


@pytest.mark.parametrize("n", [5, 7, 1000, 1029])
def test_stratified_sample(rows, n):
    got = sampling.sample_stratified(rows, n, "item_id", SEED).collect()
    wanted = {}
    for i, letter in enumerate("ABCDE"):
        of_letter = [k for k in range(3000) if k % 7 == i]
        wanted[letter] = by_hash(of_letter)[: n // 5 + (i < n % 5)]
    for letter, keys in wanted.items():
        mine = sorted((r for r in got if r["correct"] == letter), key=lambda r: r["class_rank"])
        assert [r["item_id"] for r in mine] == keys
    assert len(got) == n


def test_stratified_sample_ignores_layout(rows):
    samples = {
        frozenset(r["item_id"] for r in sampling.sample_stratified(df, 102, "item_id", 7).collect())
        for df in arrangements(rows)
    }
    assert len(samples) == 1


def test_short_and_missing_letters_are_reported(spark):
    df = spark.createDataFrame([(i, "A" if i < 50 else "B") for i in range(53)], "item_id long, correct string")
    sample = sampling.sample_stratified(df, 50, "item_id", SEED)
    report = {r["correct"]: (r["n"], r["wanted"], r["short"]) for r in sampling.balance_report(sample, 50).collect()}
    assert report == {
        "A": (10, 10, False),
        "B": (3, 10, True),
        "C": (0, 10, True),
        "D": (0, 10, True),
        "E": (0, 10, True),
    }


def test_training_sample_switches_at_the_limit(rows):
    small = sampling.sample_training(rows, 100, "item_id", SEED, stratified_limit=100)
    large = sampling.sample_training(rows, 101, "item_id", SEED, stratified_limit=100)
    assert Counter(r["correct"] for r in small.collect()) == dict.fromkeys("ABCDE", 20)
    assert {r["item_id"] for r in large.collect()} == set(by_hash(range(3000))[:101])


def test_prefixes_are_nested(rows):
    got = sampling.nested_prefixes(rows, [500, 100, 2000, 9000], "item_id", SEED).collect()
    order = by_hash(range(3000))
    assert len(got) == 3000
    for size in (100, 500, 2000, 9000):
        assert {r["item_id"] for r in got if r["smallest_n"] <= size} == set(order[:size])


def test_first_rows(rows):
    assert [r[0] for r in sampling.first_n(rows, 5, "item_id", offset=20).collect()] == [20, 21, 22, 23, 24]
    assert [r[0] for r in sampling.first_n(rows, 3, "item_id").collect()] == [0, 1, 2]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "item_id long, correct string")
    assert sampling.sample_uniform(empty, 5, "item_id", SEED).count() == 0
    assert sampling.sample_stratified(empty, 5, "item_id", SEED).count() == 0
    assert sampling.seeded_rank(empty, "item_id", SEED).count() == 0
