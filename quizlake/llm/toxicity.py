"""Toxicity grades by cumulative-link ordinal regression over sparse word features.

P(grade >= k) = s(w.x - t_k): one weight vector for all thresholds t_1 < t_2 < t_3, so the grades
share what is known about words and differ in how much of it they ask for. The expected severity is
the sum of these probabilities.

The labels say only toxic or not. Grade 0 is not toxic; the toxic documents are graded 1 to 3 by the
thirds of how many words they hold that the labels single out. Features are log(1 + count) of the
words and word beginnings whose share of documents differs most between both labels.

Fitted on a bounded sample of labelled documents (PER_LABEL of each label at most); every document is
scored on its whole text.

Defined results: a text that is null or without a word is grade 0 with severity 0; without labels of
both kinds every document is; rows repeat as they come and keys may be null; a labelled key that
repeats counts as often as it stands there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.ngram_join import slices

WORD = re.compile(r"[^\W\d_]+")
#: Documents of each label that are learned from, words that become features, grades above 0.
PER_LABEL, FEATURES, GRADES = 4000, 4096, 3


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def text_features(text: str | None) -> list[str]:
    """Words, and for longer words their first 5 and 7 letters marked with a star.

    Words of one stem share these, so that a stem is known in forms never seen."""
    words = text_words(text)
    return words + [w[:5] + "*" for w in words if len(w) > 5] + [w[:7] + "*" for w in words if len(w) > 7]


def feature_value(feature: str, count: int, words: int) -> float:
    """Log of the count; a word beginning, which long texts hold by chance, counts by its density."""
    return float(np.log1p(count * 500 / (500 + words) if feature.endswith("*") else count))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights per word and the ordered thresholds."""

    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1.. of a text."""
        size = len(text_words(text))
        if not size:
            return np.zeros(len(self.thresholds))
        counts = Counter([w for w in text_features(text) if w in self.words])
        score = sum(float(self.weights[self.words[w]]) * feature_value(w, n, size) for w, n in sorted(counts.items()))
        return _sigmoid(score - self.thresholds)


def fit_ordinal(rows: list[tuple[dict[int, float], int]], features: int, steps: int = 400, penalty: float = 2e-4):
    """Weights and thresholds for rows of (feature values, grade), by full-batch Adam.

    Thresholds are a first one plus positive gaps, so they stay in order."""
    owner = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    place = np.array([i for x, _ in rows for i in x], np.int64)
    value = np.array([n for x, _ in rows for n in x.values()], float)
    grade = np.array([g for _, g in rows])
    weight = 1 / len(rows)
    parameters = np.concatenate([np.zeros(features), [1.0], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        w, first, gaps = parameters[:features], parameters[features], np.exp(parameters[features + 1 :])
        thresholds = first + np.append(0, np.cumsum(gaps))
        score = np.bincount(owner, w[place] * value, minlength=len(rows))
        tail = np.column_stack([np.ones(len(rows)), _sigmoid(score[:, None] - thresholds), np.zeros(len(rows))])
        share = np.maximum(tail[np.arange(len(rows)), grade] - tail[np.arange(len(rows)), grade + 1], 1e-9)
        slope = tail * (1 - tail)  # of each tail in its score; 0 for the constant ends
        d_score = weight * (slope[np.arange(len(rows)), grade] - slope[np.arange(len(rows)), grade + 1]) / share
        d_threshold = np.zeros(GRADES)
        np.add.at(d_threshold, grade[grade > 0] - 1, -(weight * slope[np.arange(len(rows)), grade] / share)[grade > 0])
        np.add.at(d_threshold, grade[grade < GRADES], (weight * slope[np.arange(len(rows)), grade + 1] / share)[grade < GRADES])
        grad = np.concatenate([
            np.bincount(place, d_score[owner] * value, minlength=features) - penalty * w,
            [d_threshold.sum()],
            np.cumsum(d_threshold[::-1])[::-1][1:] * gaps,
        ])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        parameters += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return parameters[:features], parameters[features] + np.append(0, np.cumsum(np.exp(parameters[features + 1 :])))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each labelled document, counted per label within the task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text_").to_pylist(), batch.column("toxic_").to_pylist()):
            counts[toxic].update(set(text_features(text)))
    for toxic, counter in enumerate(counts):
        if counter:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counter)), pa.array([toxic] * len(counter), pa.int32()), pa.array(list(counter.values()), pa.int64())],
                ["word", "toxic", "n"],
            )


def _feature_rows(batches: Iterator[pa.RecordBatch], words: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text_").to_pylist()
        found = [sorted(Counter(w for w in text_features(t) if w in words).items()) for t in texts]
        sizes = [len(text_words(t)) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("toxic_"),
                pa.array([[words[w] for w, _ in c] for c in found], pa.list_(pa.int32())),
                pa.array([[n for _, n in c] for c in found], pa.list_(pa.int32())),
                pa.array([[feature_value(w, n, size) for w, n in c] for c, size in zip(found, sizes)], pa.list_(pa.float64())),
            ],
            ["toxic", "places", "counts", "values"],
        )


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> OrdinalModel | None:
    """A model from the labelled documents, None unless both labels occur."""
    marks = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("mark_")).agg(F.max(F.col(toxic).cast("int")).alias("toxic_"))
    totals = {r["toxic_"]: r["count"] for r in marks.groupBy("toxic_").count().collect()}
    if len(totals) < 2:
        return None
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("toxicity:"), F.col("mark_").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    share = F.when(F.col("toxic_") == 1, PER_LABEL / totals[1]).otherwise(PER_LABEL / totals[0])
    drawn = marks.where(draw < share)
    # About PER_LABEL rows of either label, whatever the table's size: small enough to send along.
    sample = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).join(F.broadcast(drawn), F.col("key_") == F.col("mark_"))
    sample = sample.groupBy("key_", "toxic_").agg(F.min("text_").alias("text_")).select("text_", "toxic_")
    sizes = drawn.groupBy("toxic_").count().collect()
    n = {r["toxic_"]: r["count"] for r in sizes}
    if len(n) < 2:
        return None
    seen = sample.mapInArrow(_word_rows, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg")
    )
    p, q = (F.col("pos") + 0.5) / (n[1] + 1), (F.col("neg") + 0.5) / (n[0] + 1)
    strength = (p - q) / F.sqrt(p * (1 - p) / n[1] + q * (1 - q) / n[0])
    best = seen.where(F.col("pos") + F.col("neg") >= 3).select("word", strength.alias("z")).where(F.abs("z") >= 2.5)
    chosen = best.orderBy(F.abs("z").desc(), "word").limit(FEATURES).collect()
    if not chosen:
        return None
    words = {r["word"]: i for i, r in enumerate(chosen)}
    telling = {i for i, r in enumerate(chosen) if r["z"] >= 4 and not r["word"].endswith("*")}
    rows = sample.mapInArrow(lambda b: _feature_rows(b, words), "toxic int, places array<int>, counts array<int>, values array<double>").collect()
    found = sorted((r["toxic"], tuple(r["places"]), tuple(r["counts"]), tuple(r["values"])) for r in rows)
    marked = [sum(c for i, c in zip(places, counts) if i in telling) for _, places, counts, _ in found]
    cuts = np.quantile([m for m, r in zip(marked, found) if r[0]] or [0], [1 / 3, 2 / 3])
    grades = [1 + int(m > cuts[0]) + int(m > cuts[1]) if r[0] else 0 for m, r in zip(marked, found)]
    weights, thresholds = fit_ordinal([(dict(zip(r[1], r[3])), g) for r, g in zip(found, grades)], len(words))
    return OrdinalModel(words, weights, thresholds)


def _grade(batches: Iterator[pa.RecordBatch], model: OrdinalModel | None) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text_")):
        names = [n for n in batch.schema.names if n != "text_"]
        tails = [model.exceed(t) if model else np.zeros(GRADES) for t in batch.column("text_").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in names],
                pa.array([int((t >= 0.5).sum()) for t in tails], pa.int32()),
                pa.array([float(t.sum()) for t in tails], pa.float64()),
                pa.array([float(t[0]) for t in tails], pa.float64()),
            ],
            [*names, "grade", "expected_severity", "p_toxic"],
        )


def grade(docs: DataFrame, model: OrdinalModel | None, text: str = "text") -> DataFrame:
    """``docs`` without its text column, plus grade (0 to 3), expected_severity and p_toxic."""
    rest = [c for c in docs.columns if c != text]
    fields = "".join(f"`{n}` {t}, " for n, t in docs.select(*rest).dtypes)
    return docs.select(*rest, F.col(text).alias("text_")).mapInArrow(lambda b: _grade(b, model), f"{fields}grade int, expected_severity double, p_toxic double")
