"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions; at every position the two states give label
probabilities, and a document's probabilities are the mean over its letters' positions. A text is cut
into stretches that are read side by side, so that one step of the recurrence serves thousands of
positions. Training is backpropagation through time in numpy, on the driver, over a bounded sample of
labelled texts; the weights are a few kilobytes and travel with the tasks.

Gates and candidates use piecewise-linear forms (0.25 x + 0.5 cut to 0..1, and x / (1 + |x|)), cheap
enough to read every byte of every text.

Defined results: a text that is null or holds no letter gets ``und`` with score 0; texts are read
whole; equal texts get equal results; of equal probabilities the first language by name wins; without
a single labelled text every document is ``und``; rows repeat as they come and null keys stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.ngram_join import slices

LETTER = regex.compile(r"\p{L}")
#: Bytes read as one stretch; a document is as many stretches as it needs.
STRETCH = 96
#: Training texts per language and bytes of each, from a hashed place: the documented bound on what is fitted.
PER_LANGUAGE, TRAINING_BYTES = 400, 4 * STRETCH


@dataclass
class Direction:
    """One direction's weights: byte table (256, 2h) and recurrence (h, 2h), gate first."""

    table: np.ndarray
    recurrent: np.ndarray

    def run(self, steps: np.ndarray, keep: bool = False):
        """States (time, rows, h) for byte codes (time, rows)."""
        hidden = self.recurrent.shape[0]
        state = np.zeros((steps.shape[1], hidden), np.float32)
        states = np.empty((*steps.shape, hidden), np.float32)
        traces = []
        for t, codes in enumerate(steps):
            drive = self.table[codes]
            drive += state @ self.recurrent
            raw, sum_ = drive[:, :hidden], drive[:, hidden:]
            gate = np.clip(0.25 * raw + 0.5, 0, 1)
            scale = np.abs(sum_)
            scale += 1
            candidate = sum_ / scale
            before = state
            state = candidate - state
            state *= gate
            state += before
            states[t] = state
            if keep:
                traces.append((before, raw, gate, scale, candidate))
        return (states, traces) if keep else states

    def backward(self, steps: np.ndarray, traces: list, upstream: np.ndarray):
        """Gradients of table and recurrence, given those of the states."""
        hidden = self.recurrent.shape[0]
        table, recurrent = np.zeros_like(self.table), np.zeros_like(self.recurrent)
        carried = np.zeros(upstream.shape[1:], np.float32)
        for t in range(len(steps) - 1, -1, -1):
            before, raw, gate, scale, candidate = traces[t]
            grad = upstream[t] + carried
            d_gate = grad * (candidate - before) * 0.25 * (np.abs(raw) < 2)
            d_sum = grad * gate / (scale * scale)
            drive = np.concatenate([d_gate, d_sum], axis=1)
            recurrent += before.T @ drive
            for column in range(2 * hidden):
                table[:, column] += np.bincount(steps[t], drive[:, column], minlength=256).astype(np.float32)
            carried = grad * (1 - gate) + drive @ self.recurrent.T
        return table, recurrent


@dataclass
class ByteTagger:
    """The network: both directions and the output layer over their states."""

    languages: list[str]
    forward: Direction
    backward: Direction
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, seed: int) -> ByteTagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)

        def direction() -> Direction:
            table = draw(256, 2 * hidden, scale=0.5)
            table[:, :hidden] -= 0.5
            return Direction(table, draw(hidden, 2 * hidden, scale=hidden**-0.5))

        return cls(languages, direction(), direction(), draw(2 * hidden, len(languages), scale=0.3), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.recurrent, self.backward.table, self.backward.recurrent, self.output, self.bias]

    def probabilities(self, steps: np.ndarray, keep: bool = False):
        """Label probabilities (time, rows, languages) for byte codes (time, rows)."""
        there = self.forward.run(steps, keep)
        back = self.backward.run(steps[::-1], keep)
        a, b = (there[0], back[0][::-1]) if keep else (there, back[::-1])
        hidden = a.shape[2]
        scores = a @ self.output[:hidden] + b @ self.output[hidden:] + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return (scores, a, b, there[1], back[1]) if keep else scores

    def gradients(self, steps: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """Gradients of the weighted cross-entropy at all positions."""
        probabilities, a, b, there, back = self.probabilities(steps, keep=True)
        delta = probabilities
        delta[:, np.arange(len(labels)), labels] -= 1
        delta *= (weights / max(weights.sum(), 1))[:, :, None]
        hidden = a.shape[2]
        output = np.concatenate([np.tensordot(a, delta, ((0, 1), (0, 1))), np.tensordot(b, delta, ((0, 1), (0, 1)))])
        up_a, up_b = delta @ self.output[:hidden].T, delta @ self.output[hidden:].T
        forward = self.forward.backward(steps, there, up_a)
        backward = self.backward.backward(steps[::-1], back, up_b[::-1])
        return [*forward, *backward, output.astype(np.float32), delta.sum(axis=(0, 1))]


def stretches(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes (time, rows), whether each position counts, and each row's text number.

    A position counts where its byte belongs to a letter: A-Z, a-z or any byte of 128 and more.
    """
    raw = [(t or "").encode() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    rows = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(raw)), rows)
    first = np.cumsum(rows) - rows
    codes = np.zeros(int(rows.sum()) * STRETCH, np.uint8)
    data = np.frombuffer(b"".join(raw), np.uint8)
    if len(data):
        place = np.arange(len(data)) + np.repeat(first * STRETCH - (np.cumsum(lengths) - lengths), lengths)
        codes[place] = _FOLD[data]
    counts = _COUNTS[codes].reshape(-1, STRETCH).T
    return np.ascontiguousarray(codes.reshape(-1, STRETCH).T), counts, owner


#: Capital A-Z read as small letters.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_COUNTS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def train(texts: list[str], labels: list[str], hidden: int = 12, epochs: int = 6, seed: int = 7) -> ByteTagger:
    """Backpropagation through time with Adam over the given texts, TRAINING_BYTES of each at most."""
    languages = sorted(set(labels))
    model = ByteTagger.fresh(languages, hidden, seed)
    steps, counts, owner = stretches([t.encode()[:TRAINING_BYTES].decode(errors="ignore") for t in texts])
    targets = np.array([languages.index(l) for l in labels], np.int64)[owner]
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step, size = 0, 256
    total = epochs * -(-len(targets) // size)
    for _ in range(epochs):
        order = rng.permutation(len(targets))
        for start in range(0, len(order), size):
            rows = order[start : start + size]
            grads = model.gradients(steps[:, rows], targets[rows], counts[:, rows].astype(np.float32))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / total)
            for p, g, (m, v) in zip(model.parameters(), grads, moments):
                g = g * min(1, 1 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def _training_stretch(key: Column, text: Column) -> Column:
    """TRAINING_BYTES characters from a hashed place of the whole text; where these hold no letter,
    those from the text's first letter on."""
    spare = F.greatest(F.length(text) - TRAINING_BYTES, F.lit(0))
    placed = F.substr(text, F.pmod(F.xxhash64(F.lit("place"), key, F.length(text)), spare + 1).cast("int") + 1, F.lit(TRAINING_BYTES))
    return F.when(placed.rlike(r"\p{L}"), placed).otherwise(F.substr(text, F.regexp_instr(text, F.lit(r"\p{L}")), F.lit(TRAINING_BYTES)))


def training_rows(docs: DataFrame, key: str, text: str, lang: str, usable: Column) -> list[tuple[str, str]]:
    """About PER_LANGUAGE labelled texts of each language, never more: (language, a stretch of the text).

    Counts per language give the share to draw; a hash of key and text draws it, and the lowest hashes
    stay. No row is moved but those drawn.
    """
    labelled = docs.where(usable & F.col(lang).isNotNull()).select(F.col(lang).alias("lang_"), F.col(key).cast("string").alias("key_"), F.col(text).alias("text_"))
    counts = {r["lang_"]: r["count"] for r in labelled.groupBy("lang_").count().collect()}
    if not counts:
        return []
    drawn = F.md5(F.concat(F.lit("langid:"), F.coalesce("key_", F.lit("")), F.lit(":"), F.xxhash64("text_").cast("string")))
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, 1.5 * PER_LANGUAGE / n * 2.0**32)])
    rows = labelled.withColumn("draw_", F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")).where(F.col("draw_") < share[F.col("lang_")])
    rows = rows.where(F.col("text_").rlike(r"\p{L}")).select("lang_", "draw_", _training_stretch(F.col("key_"), F.col("text_")).alias("text_"))
    lowest = Window.partitionBy("lang_").orderBy("draw_", "text_")
    kept = rows.withColumn("r_", F.row_number().over(lowest)).where(F.col("r_") <= PER_LANGUAGE).collect()
    return [(r["lang_"], r["text_"]) for r in sorted(kept, key=lambda r: (r["lang_"], r["r_"]))]


def _tag(batches: Iterator[pa.RecordBatch], model: ByteTagger | None, block: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text_")):
        texts = batch.column("text_").to_pylist()
        named, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
        at = 0
        while at < len(some):
            taken, size = [], 0
            while at < len(some) and (not taken or size + len(texts[some[at]]) < block):
                taken.append(some[at])
                size += len(texts[some[at]])
                at += 1
            for i, (name, score) in zip(taken, tag_texts(model, [texts[i] for i in taken], block)):
                named[i], scores[i] = name, score
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in batch.schema.names if n != "text_"], pa.array(named, pa.string()), pa.array(scores, pa.float64())],
            [*[n for n in batch.schema.names if n != "text_"], "lang_pred", "score"],
        )


def tag_texts(model: ByteTagger, texts: list[str], block: int) -> list[tuple[str, float]]:
    """Language and pooled probability of each text, a block of stretches at a time."""
    steps, counts, owner = stretches(texts)
    pooled, letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    rows = max(1, block // STRETCH)
    for start in range(0, steps.shape[1], rows):
        part = slice(start, start + rows)
        weight = counts[:, part].astype(np.float32)
        summed = np.einsum("trl,tr->rl", model.probabilities(np.ascontiguousarray(steps[:, part])), weight)
        np.add.at(pooled, owner[part], summed)
        np.add.at(letters, owner[part], weight.sum(axis=0))
    pooled /= np.maximum(letters, 1)[:, None]
    best = pooled.argmax(axis=1)
    return [(model.languages[b], float(min(1.0, max(0.0, p[b])))) for b, p in zip(best, pooled)]


def position_labels(model: ByteTagger, text: str) -> list[str]:
    """The most probable language at every byte of a text."""
    steps, _, _ = stretches([text])
    labels = model.probabilities(steps).argmax(axis=2).T.ravel()[: len(text.encode())]
    return [model.languages[i] for i in labels]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None) -> ByteTagger | None:
    """A model from the labelled rows that ``usable`` allows; None without any."""
    rows = training_rows(docs, key, text, lang, F.lit(True) if usable is None else usable)
    return train([t for _, t in rows], [name for name, _ in rows]) if rows else None


def identify(docs: DataFrame, model: ByteTagger | None, text: str = "text", block: int = 400_000) -> DataFrame:
    """``docs`` without its text column, plus lang_pred and score. Column ``text`` alone is read."""
    rest = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*rest).dtypes)
    schema = f"{fields}, lang_pred string, score double" if fields else "lang_pred string, score double"
    return docs.select(*rest, F.col(text).alias("text_")).mapInArrow(lambda b: _tag(b, model, block), schema)
