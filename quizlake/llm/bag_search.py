"""Ranked lexical search in which documents with equal bags are scored once.

1. A text is cut to terms; of its bag only the terms that some item asks for are kept, with the number
   of all its terms. What is common to all documents (how many there are, how long, how many hold a
   term) is counted over all of them.
2. The score of a document depends on its term counts and its length value m alone. Documents are hashed
   and grouped by exactly these, so that equal ones form a class, and each class is scored once, as rows
   of a matrix times the items' weights. Products stay below 2**53 or are taken in integers.
3. A task keeps, per item, as many classes as documents are asked for, by score and then by their least
   document. The best of these are expanded to their members by ascending document.

Items beyond MOST_TERMS terms together are searched in several rounds, each with a vocabulary that is
bounded and sent to the tasks; the documents are read once per round.

Defined results: null and empty texts, and those without a term, are no documents; a document without a
key is ranked behind others of equal score; every row is a document of its own; rows that repeat an item
are one item with the terms of all; rows without an item key and items without terms get nothing;
order and layout of the input do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.ngram_join import slices
from quizlake.llm.shingles import text_parts, words
from quizlake.operators.joins import attach
from quizlake.session import materialise

#: Rows (item, term) of one round, 24 bytes each in the driver and in every task.
MOST_TERMS = 2_000_000
#: Numbers in a matrix of weights, and in one of classes.
_CELLS = 2_000_000
_NO_KEY = 2**63 - 1
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed terms of every item and how often it has them."""
    for batch in batches:
        for part in slices(batch, "text_"):
            hashes, _, _, rows = words(*text_parts(part.column("text_")), ~_LETTERS)
            keys = np.repeat(part.column("item_").to_numpy(), np.diff(rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hashes.view(np.int64))], ["item", "term"])


def _bags(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Per document with a term: number of all its terms, and its counts of the vocabulary's, packed."""
    known = vocabulary.value
    place = np.uint16 if len(known) < 2**16 else np.uint32
    for batch in batches:
        for part in slices(batch, "text_"):
            hashes, _, _, rows = words(*text_parts(part.column("text_")), ~_LETTERS)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes)
            owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[hit]
            pairs, counts = np.unique(owner * len(known) + at[hit], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(len(rows)) * len(known))
            terms = (pairs % len(known)).astype(place)
            some = np.flatnonzero(np.diff(rows))
            bags = []
            for i in some.tolist():
                mine = counts[cuts[i] : cuts[i + 1]]
                wide = np.uint8 if not len(mine) or mine.max() < 256 else np.uint32
                bags.append(bytes([wide().nbytes]) + terms[cuts[i] : cuts[i + 1]].tobytes() + mine.astype(wide).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_").take(pa.array(some)), pa.array(np.diff(rows)[some]), pa.array(bags, pa.binary())], ["doc", "n", "bag"])


def _unpacked(bag: bytes, place: type) -> tuple[np.ndarray, np.ndarray]:
    size = (len(bag) - 1) // (bag[0] + place().nbytes)
    terms = np.frombuffer(bag, place, size, 1)
    return terms, np.frombuffer(bag, np.uint8 if bag[0] == 1 else np.uint32, size, 1 + terms.nbytes)


def _holders(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How many documents of this task's classes hold each term."""
    place = np.uint16 if size < 2**16 else np.uint32
    found = np.zeros(size, np.int64)
    for batch in batches:
        for bag, members in zip(batch.column("bag").to_pylist(), batch.column("members").to_pylist()):
            found[_unpacked(bag, place)[0]] += members
    some = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "df"])


class Weights:
    """Weights (item, term, weight) as matrices over some items and the terms that these ask for."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int):
        order = np.argsort(items, kind="stable")
        items, terms, weights = items[order], terms[order], weights[order]
        self.size = size
        self.names, starts, counts = np.unique(items, return_index=True, return_counts=True)
        # Scores below 2**53 are exact in doubles; no saturated count exceeds 10**6.
        self.kind = np.float64 if 10**6 * max(np.add.reduceat(weights, starts).tolist(), default=0) < 2**53 else np.int64
        self.parts, first, width = [], 0, 0
        for i, count in enumerate(counts.tolist()):
            if i > first and (width + count) * (i + 1 - first) > _CELLS:
                self.parts.append((first, i))
                first, width = i, 0
            width += count
        if len(counts):
            self.parts.append((first, len(counts)))
        self.rows = np.repeat(np.arange(len(counts)), counts)
        self.bounds, self.terms, self.weights = np.append(starts, len(items)), terms, weights

    def matrices(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last item, column of every term (-1 if not asked for) and the matrix term by item."""
        for first, last in self.parts:
            mine = slice(self.bounds[first], self.bounds[last])
            used, local = np.unique(self.terms[mine], return_inverse=True)
            column = np.full(self.size, -1, np.int64)
            column[used] = np.arange(len(used))
            matrix = np.zeros((len(used), last - first), self.kind)
            matrix[local, self.rows[mine] - first] = self.weights[mine]
            yield first, last, column, matrix


def _best(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """Per item, this task's k best classes by score, equal ones by their least document."""
    weights: Weights = sent.value
    place = np.uint16 if weights.size < 2**16 else np.uint32
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    best = [empty] * len(weights.names)
    floor = np.ones(len(weights.names), np.int64)
    for batch in batches:
        least = np.asarray(batch.column("least").fill_null(_NO_KEY))
        names, m = batch.column("class"), batch.column("m").to_numpy()
        bags = [_unpacked(bag, place) for bag in batch.column("bag").to_pylist()]
        sizes = np.array([len(t) for t, _ in bags], np.int64)
        if not len(bags) or not sizes.any():
            continue
        terms = np.concatenate([t for t, _ in bags]).astype(np.int64)
        counts = np.concatenate([c.astype(np.int64) for _, c in bags])
        owner = np.repeat(np.arange(len(bags)), sizes)
        worth = (10**9 * counts) // (1000 * counts + 12 * m[owner])
        starts = np.append(0, np.cumsum(sizes))
        for first, last, column, matrix in weights.matrices():
            step = max(1, _CELLS // len(matrix))
            for low in range(0, len(bags), step):
                high = min(low + step, len(bags))
                mine = slice(starts[low], starts[high])
                at = column[terms[mine]]
                here = at >= 0
                counted = np.zeros((high - low, len(matrix)), weights.kind)
                counted[owner[mine][here] - low, at[here]] = worth[mine][here]
                scores = (counted @ matrix).astype(np.int64)
                for j in np.flatnonzero((scores >= floor[first:last]).any(axis=0)).tolist():
                    rows = np.flatnonzero(scores[:, j] >= floor[first + j])
                    held = best[first + j]
                    score, key = np.append(held[0], scores[rows, j]), np.append(held[1], least[low + rows])
                    order = np.lexsort((key, -score))[:k]
                    own = len(held[0])
                    kept = [held[2][o] if o < own else names[low + int(rows[o - own])].as_py() for o in order.tolist()]
                    best[first + j] = (score[order], key[order], kept)
                    if len(order) == k:
                        floor[first + j] = score[order[-1]]
    for item, (score, key, kept) in zip(weights.names.tolist(), best):
        if kept:
            nulls = key == _NO_KEY
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(kept), item)), pa.array(score), pa.array(key, mask=nulls), pa.array(kept, pa.binary())], ["item_id", "score", "least", "class"]
            )


def _round(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """The k best documents of the items of one round, given as rows (item, term, times)."""
    spark = docs.sparkSession
    items, hashes, times = (np.array(c, np.int64) for c in zip(*asked))
    known, terms = np.unique(hashes.view(np.uint64), return_inverse=True)
    vocabulary = spark.sparkContext.broadcast(known)
    bags = materialise(docs.mapInArrow(lambda b: _bags(b, vocabulary), "doc long, n long, bag binary"), "bags")
    total, length = bags.agg(F.count("*"), F.sum("n")).first()
    length = length or 1
    m = F.lit(75).cast("long") + F.expr(f"(25 * n * {total}L) div {length}L")
    name = F.unhex(F.sha2(F.concat(F.col("m").cast("string").cast("binary"), F.lit(b"|"), "bag"), 256))
    members = bags.select("doc", m.alias("m"), "bag").withColumn("class", name)
    # Grouped by the bag itself: equal hashes alone do not make a class.
    classes = members.groupBy("class", "m", "bag").agg(F.min("doc").alias("least"), F.count("*").alias("members"))
    classes = materialise(classes, "classes")
    holders = classes.select("bag", "members").mapInArrow(lambda b: _holders(b, len(known)), "term long, df long")
    df = np.zeros(len(known), np.int64)
    for term, count in holders.groupBy("term").agg(F.sum("df")).toLocalIterator():
        df[term] = count
    rare = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast(Weights(items, terms, times * rare[terms], len(known)))
    best = classes.select("class", "m", "bag", "least").mapInArrow(lambda b: _best(b, sent, k), "item_id long, score long, least long, class binary")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("least").asc_nulls_last())
    won = materialise(best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("item_id", "score", "class"), "won")
    inside = Window.partitionBy("class").orderBy(F.col("doc").asc_nulls_last())
    expanded = attach(members.select("doc", "class"), won.select("class").distinct(), "class")
    expanded = expanded.withColumn("r", F.row_number().over(inside)).where(F.col("r") <= k).drop("r")
    ranked = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    rows = won.join(expanded.withColumnRenamed("doc", "doc_id"), "class")
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", most_terms: int = MOST_TERMS) -> DataFrame:
    """Per item its ``k`` best documents with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc_"), F.col(text).cast("string").alias("text_"))
    asked = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item_"), F.col(text).cast("string").alias("text_"))
    asked = asked.mapInArrow(_item_terms, "item long, term long").groupBy("item", "term").agg(F.count("*").alias("times"))
    asked = materialise(asked, "item-terms")
    rounds = -(-asked.count() // most_terms)
    out = None
    for i in range(rounds):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == i).collect()
        if rows:
            found = _round(source, rows, k)
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The query over ``documents`` and ``benchmark`` in SQL.
ORACLE = f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
    ), total AS (
        SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
    ), m AS (
        SELECT r, doc_id, 75 + (25 * len(terms) * n_docs) // n_terms AS m FROM d, total WHERE len(terms) > 0
    ), tf AS (
        SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL
    ), w AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term
    ), q AS (
        SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL
    ), scored AS (
        SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
    ) WHERE rank <= 20
"""
