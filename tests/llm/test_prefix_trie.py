import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quizlake.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, conv int, depth string, node string"


def brute(rows):
    """Nodes by plain dictionaries over whole sequences."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(rebuilt.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    out = []
    for node, convs in members.items():
        stack, leaves, saved = [node], 0, 0
        while stack:
            x = stack.pop()
            leaves += not children[x]
            saved += (len(members[x]) - 1) * (len(x[-1][1]) if x else 0)
            stack += children[x]
        sha = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children[node]), leaves, saved, sha))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def result(df, **options):
    out = trie.prefix_trie(df, **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def talk(rng, c, turns, words=3):
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"{'é' * (t + 1)} w{rng.randrange(words)}") for t in range(turns)]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    rows = [r for c in [*range(0, 130), *range(205, 230), 1000, 7050] for r in talk(rng, c, rng.randrange(1, 9), 2)]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(12)]
    rows += [(411, t, "user", f"same {t}") for t in range(90)] + [(511, t, "user", f"same {t}") for t in range(90)]
    rows += [(600, None, None, None), (600, 2, "user", ""), (600, None, "user", "x"), (600, 2, "user", ""), (602, 1, None, "t"), (None, 1, "user", "lost"), (-105, 0, "u", "minus")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force_in_any_layout(spark, mixed):
    want = brute([r for r in mixed if r[0] is None or r[0] >= 0])
    df = frame(spark, [r for r in mixed if r[0] is None or r[0] >= 0])
    assert result(df.repartition(7)) == want
    assert result(df.coalesce(1)) == want


def test_a_conversation_over_many_ranges(spark):
    rows = [(1, t, "user", f"a{t % 7}") for t in range(150)] + [(201, t, "user", f"a{t % 7}") for t in range(140)]
    assert result(frame(spark, rows).repartition(5)) == brute(rows)


def test_a_full_sketch_changes_nothing(spark, mixed, monkeypatch):
    rows = [r for r in mixed if r[0] is not None and 0 <= r[0] < 320]
    monkeypatch.setattr(trie, "shared_bits", lambda prefixes, width: np.full((2, width // 8), 255, np.uint8))
    assert result(frame(spark, rows)) == brute(rows)


def test_no_rows_and_no_turns(spark):
    assert result(frame(spark, [])) == []
    # A conversation that gives its first turns away and gets none is a member of the root.
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(lone, 0, "user", "hi")]
    assert result(frame(spark, rows)) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_screening_has_no_false_singletons(spark):
    prefixes = spark.createDataFrame([(i % 700, -(i % 700)) for i in range(1000)], "d1 long, d2 long")
    bits = trie.shared_bits(prefixes.repartition(9), 2**16)
    digests = np.arange(700)
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in (np.ones(700, int), digests, -digests, digests, digests)], ["depth", "d1", "d2", "p1", "p2"])

    class Sent:
        value = bits

    got = np.asarray(next(trie._screened([batch], Sent, 2**16)).column("shared"))
    assert got[:300].all() and got[300:].mean() < 0.05
