import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quizlake.llm import packing
from quizlake.llm.packing import ByteLevelEncoder, fill, level, pack
from quizlake.llm.queries import QUERIES
from quizlake.llm.tables import vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, texts, capacity):
    """Every id lies in one piece, and windows are gapless and within capacity."""
    windows, docs = {}, {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs.setdefault(p["doc_id"], []).append(p)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert docs.keys() == texts.keys()
    for key, found in docs.items():
        want = ids_of(texts[key])
        at = 0
        for p in sorted(found, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert np.frombuffer(p["ids"], "<u4").tolist() == want[at : at + p["length"]]
            at += p["length"]
        assert at == len(want)
    return windows


def test_odd_rows(odd):
    once = odd.dropDuplicates(["doc_id", "text"])
    texts = {r["doc_id"]: r["text"] for r in once.collect()}
    for capacity in (7, 256, 2048):
        check(pack(once, capacity=capacity).collect(), texts, capacity)
    assert pack(odd).where("doc_id = 7").groupBy().sum("length").first()[0] == 2 * len(ids_of(texts[7]))


def test_whole_table_has_little_padding(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    windows = check(pack(docs).collect(), texts, 2048)
    total = sum(n for parts in windows.values() for _, n in parts)
    assert total / (2048 * len(windows)) > 0.98


def test_query_digests(spark, folder):
    for r in QUERIES["op7_packing"].plan(spark, folder).limit(40).collect():
        text = spark.read.parquet(f"{folder}/documents.parquet").where(f"doc_id = {r['doc_id']}").first()["text"]
        part = ids_of(text)[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        break


def test_empty_table(nothing):
    assert pack(nothing).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_windows_hold_every_id_once_within_capacity(sizes):
    dealt = fill(sizes, 100)
    parts = sorted(p for w in dealt for p in w)
    for i, size in enumerate(sizes):
        at = 0
        for _, start, length in (p for p in parts if p[0] == i):
            assert start == at and length > 0
            at += length
        assert at == size
    assert all(0 < sum(p[2] for p in w) <= 100 for w in dealt)


def test_more_windows_where_one_cut_is_not_enough():
    assert level([[0, 1, 2, 3], [4]], [30, 30, 30, 30, 1], 60) is None
    assert level([[0, 1], [2]], [50, 20, 30], 60) == [[(0, 0, 50), (1, 0, 10)], [(2, 0, 30), (1, 10, 10)]]


def test_most_short_documents_stay_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    short = pack(docs).where("doc_tokens <= 2048").groupBy("doc_id").count()
    assert short.where("count > 1").count() < 0.15 * short.count()


def test_texts_are_encoded_as_by_the_library():
    encoder, rng = ByteLevelEncoder(vocabulary_path("byte_bpe_50k.json")), random.Random(5)
    odd = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "　x y z", "it's <|endoftext|>x", "a\x1c b"]
    odd += ["".join(rng.choice("ab1! \n\t'séΣ ") for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    for text in odd:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text)[:-1], repr(text)


def test_a_task_leaves_no_remembered_pieces_to_its_worker(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text of some words"])], ["key_", "text_"])
    assert sum(out.num_rows for out in packing._pack(iter([batch]), 2048, "byte_bpe_50k.json", 1)) == 1
    assert not packing._encoder("byte_bpe_50k.json").known
