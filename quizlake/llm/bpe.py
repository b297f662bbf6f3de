"""BPE encoding and decoding with an index from each symbol pair to all its positions.

All words that a batch of texts brings along lie in one flat array of symbols. An index maps every
mergeable pair to the positions where it stands; active ranks are taken in ascending order, each
merge is applied at all its positions at once, and only the lists of the pairs that a merge creates
are touched. A text's ids are those of its words, looked up piece by piece.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens in a
text become their own ids, as the tokenizers library does; rows repeat as they come; texts are
encoded whole, whatever their length; columns of the input that are not asked for are not read.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.tables import vocabulary_path

#: White space and word pattern of the vocabulary's pre-tokenizer.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SEPARATORS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WORD_OR_END = regex.compile(WORD.pattern + "|\n")
#: Controls at which str.split() parts a text although the vocabulary's pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Pieces remembered by a task before it starts afresh: bounds memory, not the result.
REMEMBERED = 500_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Encodes sets of words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.specials.items()]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.width = max(self.tokens) + 1
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of_key = key[order], order
        self.left, self.right, self.made = left, right, made

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair never merges."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        size = len(data)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        # A linked list over positions; `size` stands for "no neighbour".
        after = np.arange(1, size + 2)
        before = np.arange(-1, size)
        after[ends - 1] = size
        before[ends - lengths] = size
        before = np.append(before, size)
        symbol = np.append(symbol, -1)
        alive = np.ones(size + 1, bool)
        alive[size] = False

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            """Put the pairs that begin at these positions into the index."""
            ranks = self.ranks(symbol[positions], symbol[after[positions]])
            keep = ranks >= 0
            if not keep.any():
                return
            ranks, positions = ranks[keep], positions[keep]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for i, j in zip(bounds, bounds[1:]):
                rank, part = int(ranks[i]), positions[i:j]
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        starts = np.flatnonzero(after[:size] < size)
        enter(starts)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            at = at[alive[at] & (symbol[at] == a) & (symbol[after[at]] == b)]
            if not len(at):
                continue
            if len(lists) > 1 or a == b:
                at = np.unique(at)
            if a == b and len(at) > 1:  # in a run of equal symbols every other position merges
                chained = np.append(False, after[at[:-1]] == at[1:])
                run_start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.made[rank]
            alive[gone] = False
            after[at] = beyond
            before[beyond] = at
            before[size] = size
            left = before[at]
            enter(at[beyond < size])
            # A left neighbour that merged in this step is entered above already.
            enter(np.setdiff1d(left[left < size], at, assume_unique=False))
        kept = np.flatnonzero(alive[:size])
        owner = np.searchsorted(ends, kept, side="right")
        bounds = np.searchsorted(owner, np.arange(len(raw) + 1))
        ids = symbol[kept].tolist()
        bounds = bounds.tolist()
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]

    def pieces(self, text: str) -> list[str]:
        """White-space parts of a text: no word of the vocabulary's pattern reaches past one."""
        if _ODD.search(text):
            return [p for p in _SEPARATORS.split(text) if p]
        return text.split()

    def split_pieces(self, pieces: list[str]) -> list[list[str]]:
        """Words of each piece after normalising; a special token stays as it is."""
        plain = [p for p in pieces if not self.special_pattern.search(p)]
        joined = unicodedata.normalize("NFC", "\n".join(plain))
        # Letter by letter, for lower() alone would look at a capital sigma's neighbours.
        joined = joined.replace("\u03a3", "\u03c3").lower()
        found: dict[str, list[str]] = dict.fromkeys(pieces, [])
        words: list[str] = []
        rest = iter(plain)
        for word in WORD_OR_END.findall(joined + "\n") if plain else ():
            if word == "\n":
                found[next(rest)] = words
                words = []
            else:
                words.append(word)
        for piece in pieces:
            if self.special_pattern.search(piece):
                parts = [p for p in self.special_pattern.split(piece) if p]
                inner = self.split_pieces([p for p in parts if p not in self.specials])
                inner = iter(inner)
                found[piece] = [w for p in parts for w in ([p] if p in self.specials else next(inner))]
        return [found[p] for p in pieces]

    def encode_pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        split = self.split_pieces(pieces)
        words = list({w for ws in split for w in ws} - self.specials.keys())
        ids = dict(zip(words, self.encode_words(words))) if words else {}
        ids |= {t: [i] for t, i in self.specials.items()}
        return {p: ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]] for p, ws in zip(pieces, split)}

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own: tokens are joined by a space."""
        return " ".join([self.tokens[i] for i in ids])


@functools.cache
def _encoder(vocabulary: str) -> tuple[PairIndexEncoder, dict[str, tuple[str, str]]]:
    """The encoder of a worker and what it remembers: pieces with their ids and decoded text."""
    return PairIndexEncoder(vocabulary_path(vocabulary)), {}


def _map_texts(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encoder, known = _encoder(vocabulary)
    for batch in batches:
        texts = [t or "" for t in batch.column("text_").to_pylist()]
        if len(known) > REMEMBERED:
            known.clear()
        new: set[str] = set()
        for t in texts:
            new.update(encoder.pieces(t))
        new -= known.keys()
        gc.disable()  # many small lists, none in a cycle
        for piece, ids in encoder.encode_pieces(list(new)).items():
            known[piece] = (" ".join(map(str, ids)), encoder.decode(ids))
        gc.enable()
        counts, lines, decoded = [], [], []
        for t in texts:
            found = [known[p] for p in encoder.pieces(t)]
            line = " ".join([x[0] for x in found])
            counts.append(line.count(" ") + 1 if line else 0)
            lines.append(line)
            decoded.append(" ".join([x[1] for x in found]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key_"), pa.array(counts, pa.int64()), pa.array(lines, pa.string()), pa.array(decoded, pa.string())],
            ["key_", "n_tokens", "id_text", "decoded"],
        )


def encode_decode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json"
) -> DataFrame:
    """Per row of ``docs``: key, n_tokens, id_text (decimal ids parted by a space) and decoded."""
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).mapInArrow(
        lambda batches: _map_texts(batches, vocabulary),
        f"key_ {kind}, n_tokens long, id_text string, decoded string",
    ).withColumnRenamed("key_", key)


def encode_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Per row of ``docs``: key and its ids as an array."""
    ids = F.filter(F.split("id_text", " "), lambda x: x != "")
    return encode_decode(docs, key, text, vocabulary).select(key, ids.cast("array<int>").alias("ids"))
