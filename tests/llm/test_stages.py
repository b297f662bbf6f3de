import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from quizlake.llm import stages
from quizlake.llm.tables import small_batches, vocabulary_path
from tests.llm.conftest import SCHEMA, edited, rows, words


def test_names_and_count():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard_join", "substring_dedup", "packing"]


def test_every_stage_on_odd_rows(spark, odd, folder):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {4, 5, 8, 9, 10, 12, None}
    assert docs.where("doc_id = 5").count() == 1
    assert stages.packed(spark, docs, folder).select("doc_id").distinct().count() == len(kept)


def test_every_stage_on_no_rows(spark, nothing, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).collect() == []


def test_similar_documents_leave_the_least_key(spark, folder):
    base = words(1, 100)
    texts = [(9, " ".join(base)), (4, " ".join(edited(base, 1, 2))), (6, " ".join(words(2, 80))), (6, " ".join(words(2, 80))), (None, " ".join(base))]
    kept = stages.one_of_each(spark, spark.createDataFrame(rows(texts), SCHEMA), folder).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 4, 6]


def test_repeats_are_cut_and_lengths_follow(spark, folder):
    passage = words(3, 60)
    texts = [(1, " ".join(passage)), (2, " ".join(["start", *passage, "end"])), (3, " ".join(passage)), (4, "clean text")]
    kept = {r["doc_id"]: r for r in stages.without_repeats(spark, spark.createDataFrame(rows(texts), SCHEMA), folder).collect()}
    assert set(kept) == {1, 2, 4}
    assert kept[2]["text"].split() == ["start", "end"] and kept[2]["n_chars"] == len(kept[2]["text"])
    assert kept[1]["text"] == texts[0][1] and kept[4]["text"] == "clean text"


def test_smaller_batches_hold_inside_only(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 7):
        sizes = [r["n"] for r in spark.range(0, 30, 1, 1).mapInArrow(count_rows, "n long").collect()]
    assert sizes == [7, 7, 7, 7, 2] and spark.conf.get(name) == before


def count_rows(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])


def test_the_pipeline_by_what_must_hold_of_its_rows(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    windows, parts = {}, {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        parts.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"]), p["doc_tokens"]))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    texts = {}
    for key, found in parts.items():
        ids = np.frombuffer(b"".join(raw for _, raw, _ in sorted(found)), "<u4").tolist()
        assert len(ids) == found[0][2] and ids[-1] == 1
        texts[key] = library.decode(ids[:-1], skip_special_tokens=False)
    assert set(texts) <= set(docs)
    # What is left is the document's text, or that without passages that stand elsewhere.
    words_of = {key: [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w] for key, text in texts.items()}
    for key, left in words_of.items():
        whole = iter(re.split(r"[\x20\x09-\x0D]+", docs[key]["text"]))
        assert all(w in whole for w in left), key
    # No run of fifty words stands in two documents, and so no copy is left.
    holder: dict[tuple, int] = {}
    for key in sorted(words_of):
        runs = {tuple(w.lower() for w in words_of[key][i : i + 50]) for i in range(len(words_of[key]) - 49)}
        assert not any(holder.get(run, key) != key for run in runs), key
        holder |= {run: key for run in runs}
    clean = [key for key, mark in toxic.items() if not mark and docs.get(key) and docs[key]["text"]]
    # Fifty labelled ones in four languages teach this much.
    assert sum(key in texts for key, mark in toxic.items() if mark) <= 0.3 * sum(toxic.values())
    assert sum(key in texts for key in clean) > 0.6 * len(clean)
