import random

import pytest
from tokenizers import Tokenizer

from quizlake.llm.bpe import PairIndexEncoder, encode_decode, encode_ids
from quizlake.llm.tables import vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return PairIndexEncoder(vocabulary_path("word_bpe_49k.json"))


def check(library, text, ids, decoded):
    want = library.encode(text or "", add_special_tokens=False).ids
    assert ids == want
    assert decoded == library.decode(want, skip_special_tokens=False)


def test_odd_rows(odd, library):
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["id_text"], r["decoded"], r["n_tokens"]) for r in encode_decode(odd).collect())
    assert len(got) == len(texts)
    by_key = {}
    for _, key, ids, decoded, n in got:
        by_key.setdefault(key, []).append(([int(i) for i in ids.split()], decoded, n))
    for _, key, text in texts:
        ids, decoded, n = by_key[key][0]
        check(library, text, ids, decoded)
        assert n == len(ids)


def test_whole_table(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in encode_decode(docs).collect():
        check(library, texts[r["doc_id"]], [int(i) for i in r["id_text"].split()], r["decoded"])


def test_random_texts(encoder, library):
    rng = random.Random(3)
    alphabet = "aaabbnnthe 'sllΣσİé́12½🙂\n\t\x1c\x85　<|endoftext|>!?"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        known = encoder.encode_pieces(encoder.pieces(text))
        ids = [i for p in encoder.pieces(text) for i in known[p]]
        check(library, text, ids, encoder.decode(ids))


def test_empty_table(nothing):
    assert encode_decode(nothing).collect() == []
    assert encode_ids(nothing).collect() == []


def test_ids_as_arrays(spark):
    df = spark.createDataFrame([("a", "hello world"), ("b", None)], "doc_id string, text string")
    got = {r["doc_id"]: r["ids"] for r in encode_ids(df).collect()}
    assert len(got["a"]) == 2 and got["b"] == []
