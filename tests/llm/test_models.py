"""Language identification and toxicity: gradients, oddities and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlake.llm import langid, toxicity
from quizlake.llm.queries import QUERIES
from tests.llm.conftest import SCHEMA


def test_backpropagation_matches_finite_differences():
    model = langid.ByteTagger.fresh(["a", "b", "c"], 4, 1)
    for p in model.parameters():
        p[:] = p.astype(np.float32)
    rng = np.random.default_rng(0)
    steps, labels = rng.integers(97, 105, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    weights = (rng.random((7, 5)) < 0.8).astype(np.float32)

    def loss():
        probabilities = model.probabilities(steps).astype(float)
        return -(np.log(probabilities[:, np.arange(5), labels]) * weights).sum() / weights.sum()

    grads = model.gradients(steps, labels, weights)
    for p, g in zip(model.parameters(), grads):
        flat, slopes = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(slopes))[:4]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(slopes[i], rel=0.1, abs=2e-3)


def test_stretches_cover_every_byte():
    texts = ["x" * (3 * langid.STRETCH + 5), "", None, "é" * langid.STRETCH]
    steps, counts, owner = langid.stretches(texts)
    assert counts.sum() == 3 * langid.STRETCH + 5 + 2 * langid.STRETCH
    assert np.bincount(owner, minlength=4).tolist() == [4, 0, 0, 2]
    assert steps.shape == (langid.STRETCH, 6)


def test_language_of_held_out_documents(spark, folder):
    got = QUERIES["op3_language_id"].plan(spark, folder).where("held_out")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("d"), "lang")
    right = got.join(docs, F.col("doc_id") == F.col("d")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


@pytest.fixture(scope="module")
def model():
    texts = {"en": "the cat and the dog went with this", "de": "der hund und die katze ging nicht über"}
    return langid.train([t for t in texts.values() for _ in range(40)], [l for l in texts for _ in range(40)], hidden=6, epochs=8)


def test_language_of_odd_rows(odd, nothing, model):
    got = langid.identify(odd.select("doc_id", "score", "text").withColumnRenamed("score", "lang"), model)
    named = {}
    for r in got.collect():
        named.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got.count() == odd.count()
    assert named[1] == named[2] == named[3] == [("und", 0.0)]
    assert named[4] == named[13] and named[7][0] == named[7][1]
    assert all(n in ("en", "de") and 0 <= s <= 1 for n, s in [*named[10], *named[12], *named[None]])
    assert langid.identify(nothing.select("doc_id", "text"), model).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd.select("doc_id", "text"), None).collect()} == {"und"}
    assert len(langid.position_labels(model, "the cat é")) == 10


def test_no_labels_no_model(odd, nothing):
    assert langid.fit(nothing) is None
    assert langid.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None


def labelled(spark):
    texts = [(i, " ".join([f"w{i % 7}", f"w{i % 11}", *(["vile", "foul"][: i % 3])])) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k", 1, 2, "x", (3,)) for i, t in texts], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i, _ in texts] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_grades_follow_the_words(spark, odd, nothing):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    graded = {r["doc_id"]: r for r in toxicity.grade(docs.select("doc_id", "text"), model).collect()}
    assert all((graded[i]["grade"] > 0) == (i % 3 > 0) for i in graded)
    assert graded[2]["expected_severity"] > graded[0]["expected_severity"]
    rest = toxicity.grade(odd.select("doc_id", "score", "text"), model)
    assert rest.count() == odd.count()
    assert {r["expected_severity"] for r in rest.where("doc_id in (1, 2, 3)").collect()} == {0.0}
    assert toxicity.grade(nothing.select("doc_id", "text"), model).collect() == []
    assert toxicity.fit(docs, labels.where("toxic = 1")) is None and toxicity.fit(nothing, labels) is None
    assert {r["grade"] for r in toxicity.grade(docs.select("doc_id", "text"), None).collect()} == {0}


def test_ordinal_fit_orders_thresholds_and_shares_weights():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(400):
        n = int(rng.integers(0, 8))
        rows.append(({0: float(np.log1p(n)), 1: float(rng.random())}, min(3, n // 2)))
    weights, thresholds = toxicity.fit_ordinal(rows, 2)
    assert weights[0] > 5 * abs(weights[1]) and (np.diff(thresholds) > 0).all()


def test_toxicity_of_held_out_documents(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip(f"{folder} is not there")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    graded = toxicity.grade(docs.select("doc_id", "text"), toxicity.fit(docs, labels.where(~held))).join(labels.where(held), "doc_id")
    shares = {r["toxic"]: r["flagged"] for r in graded.groupBy("toxic").agg(F.avg((F.col("grade") > 0).cast("int")).alias("flagged")).collect()}
    assert shares[1] >= 0.75 and shares[0] <= 0.01


def test_languages_whose_texts_begin_with_numbers_are_learned(spark):
    rng = random.Random(4)
    numbers = " ".join(str(rng.randrange(10**6)) for _ in range(100))[:600]
    german = [" ".join(rng.choice(["und", "für", "straße", "nicht", "über", "wenn"]) for _ in range(60)) for _ in range(120)]
    english = [" ".join(rng.choice(["the", "which", "though", "water", "should", "and"]) for _ in range(60)) for _ in range(120)]
    rows = [(i, f"{numbers} {t}", "de") for i, t in enumerate(german)] + [(500 + i, f"{numbers} {t}", "en") for i, t in enumerate(english)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid.training_rows(docs, "doc_id", "text", "lang", F.lit(True))
    assert {name for name, _ in drawn} == {"de", "en"} and len(drawn) > 150
    named = langid.identify(docs.select("doc_id", "lang", "text"), langid.fit(docs)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in named) > 0.95 * len(named)


def test_rows_that_repeat_do_not_widen_the_training_sample(spark):
    docs = spark.createDataFrame([(1, "the same words again", "en")] * 3000 + [(2, "und noch einmal", "de")], "doc_id long, text string, lang string")
    assert len(langid.training_rows(docs, "doc_id", "text", "lang", F.lit(True))) <= 2 * langid.PER_LANGUAGE


def cumulative_link_loss(weights, thresholds, rows, penalty):
    """Mean negative log-likelihood of the grades by the textbook's formula, row by row."""
    total = 0.0
    for features, grade in rows:
        score = sum(weights[i] * x for i, x in features.items())
        tails = [1.0] + [1 / (1 + np.exp(t - score)) for t in thresholds] + [0.0]
        total -= np.log(max(tails[grade] - tails[grade + 1], 1e-12))
    return total / len(rows) + penalty / 2 * float((weights**2).sum())


def test_the_ordinal_fit_is_a_minimum_of_the_plain_loss():
    rng = np.random.default_rng(8)
    truth, cuts = np.array([1.5, -1.0, 0.5, 0.0]), np.array([0.3, 1.2, 2.0])
    rows = []
    for _ in range(400):
        features = {int(i): float(x) for i, x in enumerate(rng.normal(size=4)) if rng.random() < 0.8}
        score = sum(truth[i] * x for i, x in features.items()) + rng.logistic()
        rows.append((features, int((score > cuts).sum())))
    weights, thresholds = toxicity.fit_ordinal(rows, 4, steps=3000, penalty=2e-4)
    assert (np.diff(thresholds) > 0).all()
    best = cumulative_link_loss(weights, thresholds, rows, 2e-4)
    assert best <= cumulative_link_loss(truth, cuts, rows, 2e-4) + 1e-3
    for i in range(7):
        for step in (-0.05, 0.05):
            w, t = weights.copy(), thresholds.copy()
            (w if i < 4 else t)[i if i < 4 else i - 4] += step
            assert cumulative_link_loss(w, t, rows, 2e-4) >= best - 1e-5
    assert np.abs(weights - truth).max() < 0.5 and np.abs(thresholds - cuts).max() < 0.5
