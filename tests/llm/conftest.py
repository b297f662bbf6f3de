import random

import pytest

#: Columns that operators use inside, to see that they do not clash.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key_ string, rep long, seed int, score string, row struct<a:int>"


def words(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def edited(source: list[str], seed: int, edits: int) -> list[str]:
    rng, out = random.Random(seed), list(source)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[at] = f"n{rng.randrange(10**6)}"
        elif kind < 0.7:
            del out[at]
        else:
            out.insert(at, f"n{rng.randrange(10**6)}")
    return out


def rows(texts: list[tuple[int | None, str | None]], lang: str | None = "en") -> list[tuple]:
    return [(i, t, lang, "s", len(t or ""), "k", 1, 2, "x", (3,)) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity at once: nulls, blanks, repeats, copies and a very long text."""
    base = words(1, 120)
    texts: list[tuple[int | None, str | None]] = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one two"),
        (5, " ".join(base)),
        (6, "  ".join(base).upper()),
        (7, " ".join(edited(base, 3, 2))),
        (7, " ".join(edited(base, 3, 2))),
        (8, " ".join(words(9, 150))),
        (9, "same " * 400),
        (10, " ".join(words(11, 60_000))),
        (None, " ".join(base)),
        (12, "é ü 中文 🙂 <|endoftext|> \x1c It's I'M"),
        (13, "one two"),
    ]
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
