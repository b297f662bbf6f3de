"""Corpus stages: each takes documents and returns those it keeps, with the same columns.

Rows keep every column they came with, whatever its name; decisions are made from ``doc_id`` and
``text`` alone. Documents that a stage has no reason to touch pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import langid, ngram_join, packing, substring_dedup, toxicity
from quizlake.llm.tables import small_batches, table

#: Least pooled probability of the language found; below, the text is of no language learned.
LEAST_SCORE = 0.35
#: Keys (8 or 16 bytes each) up to which a list of documents to drop is sent to them.
BROADCAST = 2_000_000


def _prints(docs: DataFrame) -> list[Column]:
    """Two hashes of a document's text, null texts alike."""
    return [F.xxhash64(F.lit(i), docs["text"]).alias(f"print{i}_") for i in (1, 2)]


def _judged(docs: DataFrame) -> DataFrame:
    """What the text stages are given: each text and its prints, and nothing to carry through."""
    return docs.select(*_prints(docs), "text")


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def _without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """Documents whose text is not among the rejected prints. Texts go to Python once and do not come
    back; their documents are dropped where they lie."""
    with small_batches(docs.sparkSession):
        drop = ngram_join.materialise(rejected.select("print1_", "print2_").distinct(), name)
    one, two = _prints(docs)
    return docs.join(_sent(drop), (one == F.col("print1_")) & (two == F.col("print2_")), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in one of the languages of the ``lang`` column, by their text."""
    named = langid.identify(_judged(docs), langid.fit(docs))
    return _without(docs, named.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)), "unknown")


def not_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents of grade 0; the grades are learned from the ``labels`` of the documents at hand."""
    graded = toxicity.grade(_judged(docs), toxicity.fit(docs, table(spark, folder, "labels")))
    return _without(docs, graded.where("grade > 0"), "toxic")


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, that of the least key, of every group of similar ones; rows without a key stay.
    Of rows that repeat a key, one stays for each of their texts."""
    with small_batches(spark):
        found = ngram_join.materialise(ngram_join.jaccard_components(docs), "components")
    drop = found.where("component_id != doc_id").select(F.col("doc_id").alias("drop_")).distinct()
    kept = docs.join(_sent(drop), F.col("doc_id") == F.col("drop_"), "left_anti")
    twice = found.where("doc_id is not null and component_id = doc_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_"))
    if twice.isEmpty():
        return kept
    again = F.col("doc_id") == F.col("twice_")
    return kept.join(twice, again, "left_anti").union(kept.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def without_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; ``n_chars`` follows the text. A
    document of which no word is left goes."""
    with small_batches(spark):
        passages = ngram_join.materialise(substring_dedup.repeated_passages(docs), "passages")
    cut = substring_dedup.without_passages(docs, passages)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        columns[at] = F.when(F.col("cut_"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return cut.where(~F.col("cut_") | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*columns)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents' ids in windows of 2048."""
    return packing.pack(docs)
