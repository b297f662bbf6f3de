"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A task reads its documents in order. Whatever fills whole windows is cut off at once; the remainders
are collected whole until they amount to a round of windows, and dealt to the windows by differencing:
every remainder starts as a partial partition with one loaded window, and the two partial partitions
with the largest imbalances are merged, heavy windows of one onto light windows of the other, until one
is left. The windows are nearly equal then; what some hold beyond their capacity is cut off and laid
into the room of others, and where there is none the round is dealt anew to one window more. Rounds never leave their task: nothing is shuffled, nothing grows with the input
but the number of rounds.

Defined results: a null or empty text is a document of its end id alone; texts are read whole and
cut as often as they need; rows repeat as they come, each packed for itself; a null key stays null;
an empty table gives no pieces. Window numbers are unique in one run: task number times 2**33 plus a
count within the task.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.tables import hand_back, vocabulary_path

#: Fixed value: the split pattern of byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Windows in a round: more make a round more even, its differencing slower.
ROUND = 64
#: Part of a round's capacity that is left free, so that few rounds need a window more.
SLACK = 1 / 128
#: Pieces of text remembered by a task before it starts afresh: bounds memory, not the result.
REMEMBERED = 600_000


#: White space but blank and line feed.
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (32, 10)]


class _Remembered(dict):
    """Ids of a piece of text as little-endian bytes, found on first use."""

    def __init__(self, encode: tiktoken.Encoding):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode.encode(piece, allowed_special="all") if "<|" in piece else self.encode.encode_ordinary(piece)
        found = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class ByteLevelEncoder:
    """Ids of whole texts by a byte-level vocabulary file.

    A single space between two other characters always begins a word of the split pattern, so a text
    is taken apart there and every part is encoded once.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        byte_of = {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in {x["content"] for x in spec["added_tokens"]}}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        encoding = tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=specials)
        if any("<|" not in name for name in specials):
            raise ValueError(f"special tokens are known by <|, which {sorted(specials)} lack")
        self.known = _Remembered(encoding)
        self.safe = re.compile(r"(?<=\S) (?=\S)")

    @staticmethod
    def uneven(text: str) -> bool:
        """Whether a space may stand at an end or beside other white space."""
        return text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_SPACE)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = self.safe.split(text) if self.uneven(text) else text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        return b"".join(map(self.known.__getitem__, parts))


@functools.cache
def _encoder(vocabulary: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(vocabulary_path(vocabulary))


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal numbered sizes to windows by multiway differencing: the numbers in each window."""
    heap = []
    for i, size in enumerate(sizes):
        load = np.zeros(windows, np.int64)
        load[0] = size
        heap.append((-size, i, load, [[i]] + [[] for _ in range(windows - 1)]))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, load_a, held_a = heapq.heappop(heap)
        _, _, load_b, held_b = heapq.heappop(heap)
        load = load_a + load_b[::-1]  # loads descend: the heaviest window meets the lightest
        order = np.argsort(-load, kind="stable")
        load = load[order]
        held_b.reverse()
        held = [held_a[i] + held_b[i] if held_b[i] else held_a[i] for i in order.tolist()]
        load -= load[-1]  # only differences matter
        heapq.heappush(heap, (-int(load[0]), made, load, held))
        made += 1
    return heap[0][3] if heap else [[] for _ in range(windows)]


def level(dealt: list[list[int]], sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]] | None:
    """Windows of parts (number, start, length): what a window holds beyond the capacity is cut from its
    least sufficient size, once a window, and laid into the others' room, widest first. None where one
    cut is not enough or there is no room."""
    windows = [[(i, 0, sizes[i]) for i in window] for window in dealt]
    room, loose = [], []
    for w, window in enumerate(windows):
        over = sum(part[2] for part in window) - capacity
        if over < 0:
            room.append((over, w))
        elif over:
            part = min((p for p in window if p[2] >= over), key=lambda p: p[2], default=None)
            if part is None:
                return None
            window.remove(part)
            if over < part[2]:
                window.append((part[0], 0, part[2] - over))
            loose.append((part[0], part[2] - over, over))
    heapq.heapify(room)
    for number, start, size in sorted(loose, key=lambda p: -p[2]):
        while size:
            if not room:
                return None
            free, w = heapq.heappop(room)
            laid = min(size, -free)
            windows[w].append((number, start, laid))
            start, size = start + laid, size - laid
            if -free > laid:
                heapq.heappush(room, (free + laid, w))
    return windows


def fill(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Deal sizes to as few windows as they need, none above the capacity: parts (number, start, length)."""
    windows = max(1, -(-sum(sizes) // capacity))
    while (found := level(difference(sizes, windows), sizes, capacity)) is None:
        windows += 1
    return [w for w in found if w]


class _Task:
    """Packs one task's documents; yields pieces as (row, start, length, sequence, offset)."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.blocks: list[tuple] = []
        self.held = 0

    def whole(self, row, start: int) -> tuple:
        self.next += 1
        return row, start, self.capacity, self.next - 1, 0

    def add(self, row, size: int) -> Iterator[tuple]:
        full = size // self.capacity
        for i in range(full):
            yield self.whole(row, i * self.capacity)
        start, rest = full * self.capacity, size % self.capacity
        if rest:
            self.blocks.append((row, start, rest))
            self.held += rest
        if self.held >= ROUND * self.capacity * (1 - SLACK):
            yield from self.deal()

    def deal(self) -> Iterator[tuple]:
        """Deal the collected blocks; what goes beyond a round's room waits for the next."""
        room, taken = int(ROUND * self.capacity * (1 - SLACK)), []
        if self.held > room:
            while self.held > room and self.blocks[-1][2] <= self.held - room:
                taken.append(self.blocks.pop())
                self.held -= taken[-1][2]
            if self.held > room:
                row, start, size = self.blocks.pop()
                keep = size - (self.held - room)
                taken.append((row, start + keep, size - keep))
                self.blocks.append((row, start, keep))
        blocks, self.blocks = self.blocks, taken[::-1]
        self.held = sum(b[2] for b in self.blocks)
        for window in fill([b[2] for b in blocks], self.capacity):
            offset = 0
            for number, start, size in sorted(window):
                row, first, _ = blocks[number]
                yield row, first + start, size, self.next, offset
                offset += size
            self.next += 1


_PIECE = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, end = _encoder(vocabulary), np.array([end_id], "<u4").tobytes()
    task = _Task(capacity, TaskContext.get().partitionId() << 33)
    kind, out, size = None, [], 0

    def made() -> pa.RecordBatch:
        columns = zip(*[(r[1], r[2], r[0][1][4 * r[1] : 4 * (r[1] + r[2])], len(r[0][1]) // 4, r[3], r[4]) for r in out])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0][0] for r in out], kind), *(pa.array(c, f.type) for c, f in zip(columns, _PIECE))],
            ["key_", *_PIECE.names],
        )

    try:
        for batch in batches:
            kind = batch.column("key_").type
            for key, text in zip(batch.column("key_").to_pylist(), batch.column("text_")):
                row = (key, encoder.encode(text.as_py() or "") + end)
                for piece in task.add(row, len(row[1]) // 4):
                    out.append(piece)
                    size += piece[2]
                if size > 2_000_000:
                    yield made()
                    out, size = [], 0
        while task.blocks:
            out += task.deal()
        if out:
            yield made()
    finally:
        # The worker goes on to other stages' tasks, which would carry what it remembers.
        encoder.known.clear()
        hand_back()


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 1,
) -> DataFrame:
    """Pieces of the documents' ids: key, start, length, ids (little-endian binary), doc_tokens,
    sequence_id and offset."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).mapInArrow(
        lambda batches: _pack(batches, capacity, vocabulary, end_id),
        f"key_ {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    ).withColumnRenamed("key_", key)
