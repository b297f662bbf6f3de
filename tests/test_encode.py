import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizlake.operators import encode as enc
from quizlake.operators.batches import length_batches, padding_report

TEXTS = [
    (1, "x", "the cat the dog\n the end", "cat"),
    (2, "x", "", "dog dog"),
    (3, "y", None, None),
    (4, "y", "a  b\tc d e f g the", "end"),
    (5, "y", " \n ", "zebra"),
]


def words(text):
    return [w for w in re.split(r"[ \n\t\r]+", text or "") if w]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "key long, batch string, text string, label string")


@pytest.fixture(scope="module")
def vocabulary(texts):
    return enc.build_vocabulary(texts, "text", 5)


def test_vocabulary(vocabulary):
    counts = Counter(w for _, _, text, _ in TEXTS for w in words(text))
    wanted = sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:5]
    got = vocabulary.orderBy("token_id").collect()
    assert [(r["token"], r["n"]) for r in got] == wanted
    assert [r["token_id"] for r in got] == [2, 3, 4, 5, 6]


def expected(vocabulary, text, length, width):
    ids = {r["token"]: r["token_id"] for r in vocabulary.collect()}
    row = [ids.get(w, 1) for w in words(text)][:length]
    pad = [0] * (width - len(row))
    return row + pad, [1] * len(row) + pad, len(words(text)), len(words(text)) > length


@pytest.mark.parametrize("literal_bytes", [10**9, 0])
def test_fixed_length(texts, vocabulary, literal_bytes):
    got = enc.encode(texts, "key", {"text": 4, "label": 2}, vocabulary, literal_bytes=literal_bytes)
    rows = {r["key"]: r for r in got.collect()}
    assert len(rows) == len(TEXTS)
    for key, _, text, label in TEXTS:
        row = rows[key]
        for name, value, length in (("text", text, 4), ("label", label, 2)):
            ids, mask, count, cut = expected(vocabulary, value, length, length)
            assert (row[f"{name}_ids"], row[f"{name}_mask"]) == (ids, mask)
            assert (row[f"{name}_tokens"], row[f"{name}_cut"]) == (count, cut)


def test_longest_in_batch(texts, vocabulary):
    rows = enc.encode(texts, "key", {"text": 6}, vocabulary, "longest", "batch").collect()
    assert {r["key"]: len(r["text_ids"]) for r in rows} == {1: 6, 2: 6, 3: 6, 4: 6, 5: 6}
    short = enc.encode(texts.where("key in (2, 3, 5)"), "key", {"text": 6}, vocabulary, "longest", "batch")
    assert {len(r["text_ids"]) for r in short.collect()} == {0}


def test_padding_arguments(texts, vocabulary):
    with pytest.raises(ValueError):
        enc.encode(texts, "key", {"text": 4}, vocabulary, padding="other")
    with pytest.raises(ValueError):
        enc.encode(texts, "key", {"text": 4}, vocabulary, padding="longest")


def test_vocabulary_counts_whole_texts(spark, folder):
    from quizlake.plans import fixtures

    documents = fixtures.documents(spark, folder)
    counts = Counter(w for r in documents.select("text").collect() for w in words(r["text"]))
    top = enc.build_vocabulary(documents, "text", 50).collect()
    assert {r["token"]: r["n"] for r in top} == dict(sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:50])


def test_truncation_report(texts):
    rows = {r["batch"]: r for r in enc.truncation_report(texts, ["batch"], "text", 5).collect()}
    assert tuple(rows["x"])[1:] == (2, 1, 1, 6)
    assert tuple(rows["y"])[1:] == (3, 1, 3, 8)


def test_common_word_is_one_row_per_task(spark):
    df = spark.range(100).select(F.lit("the the the").alias("text"))
    plan = enc.build_vocabulary(df, "text", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") == 1


@pytest.mark.parametrize("literal_bytes", [10**9, 0])
def test_null_and_repeated_keys_keep_their_rows(spark, vocabulary, literal_bytes):
    rows = [(None, "the cat"), (None, "dog end the"), (7, "the"), (7, "cat cat cat"), (7, "the"), (8, None)]
    df = spark.createDataFrame(rows, "key long, text string").repartition(3)
    got = enc.encode(df, "key", {"text": 4}, vocabulary, literal_bytes=literal_bytes).collect()
    want = [(key, *expected(vocabulary, text, 4, 4)) for key, text in rows]
    assert sorted(((r["key"], r["text_ids"], r["text_mask"], r["text_tokens"], r["text_cut"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("group_rows", [10**6, 3])
def test_batches_of_nearly_one_length(spark, group_rows):
    rows = [(i, i * i % 11) for i in range(100)] + [(100 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "key long, n int").repartition(4)
    got = length_batches(df, "key", "n", 8, group_rows=group_rows).collect()
    assert Counter(r["batch"] for r in got) == {i: 8 for i in range(13)} | {13: 1}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"42:{r[0]}".encode()).hexdigest()))
    assert {r["key"]: r["batch"] for r in got} == {key: place // 8 for place, (key, _) in enumerate(order)}
    assert length_batches(df.limit(0), "key", "n", 8).collect() == []


def test_own_batches_pad_less(spark, vocabulary):
    rows = [(i, " ".join(["the"] * (1 + i * 7 % 40))) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, text string")
    tight = enc.encode(df, "key", {"text": 32}, vocabulary, padding="longest", batch_size=10)
    report = padding_report(tight, ["text"]).first()
    assert report["n"] == 200 and report["text_used"] == sum(min(1 + i * 7 % 40, 32) for i in range(200))
    wide = padding_report(enc.encode(df, "key", {"text": 32}, vocabulary), ["text"]).first()
    assert report["text_padding"] < 0.06 < 0.3 < wide["text_padding"]
    for r in tight.collect():
        assert len(r["text_ids"]) == max(len([x for x in q["text_mask"] if x]) for q in tight.where(f"batch = {r['batch']}").collect()) if r["key"] < 2 else True
    with pytest.raises(ValueError):
        enc.encode(df, "key", {"text": 4}, vocabulary, batch_size=3)


def test_rows_of_one_length_are_numbered_by_several_tasks(spark):
    from pyspark.sql import functions as F

    from quizlake.operators.batches import length_batches

    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        numbered = length_batches(spark.range(200_000).withColumn("n", F.lit(512)), "id", "n", 32)
        per_task = [r["count"] for r in numbered.select(F.spark_partition_id().alias("p"), "batch").groupBy("p").count().collect()]
        assert sum(per_task) == 200_000 and max(per_task) < 200_000
        assert numbered.groupBy("batch").count().where("count != 32").count() == 0
    finally:
        spark.conf.set(name, before)
