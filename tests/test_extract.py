"""The text rules on strings chosen to trip them."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions import extract

# text, then what clean_letter, last_letter, last_letter_after(1), last_number_text,
# letter_after_phrase and strict_letter give
CASES = [
    ("Answer: C", "C", "C", None, None, None, "N/A"),
    ("The answer is: B", None, "B", None, None, "B", "N/A"),
    ("The answer is B", "B", "B", None, None, "B", "N/A"),
    ("answer is **D**", "D", None, None, None, "D", "N/A"),
    ("answer is (A)", None, None, None, None, "A", "N/A"),
    ("Answer: (B)", None, None, None, None, None, "N/A"),
    ("The answer is described here", "D", "D", None, None, "D", "N/A"),
    ("answer because", None, "B", None, None, None, "N/A"),
    ("Answer:\n\n  e", "E", "E", None, None, None, "N/A"),
    ("answer is A. Later, Answer: B", "B", "B", "B", None, "A", "N/A"),
    ("no letter", None, None, None, None, None, "N/A"),
    ("", None, None, None, None, None, "N/A"),
    ("Output: Answer: A\n\nInstruction q Output: x Answer: D", "A", "D", "D", None, None, "N/A"),
    ("correct option is: c", None, "C", None, None, None, "N/A"),
    ("ANSWER IS \xe9 a", None, None, None, None, None, "N/A"),
    ("anſwer is B", "B", "B", None, None, None, "N/A"),
    ("answer\xa0is B", "B", "B", None, None, None, "N/A"),
    ("The correct answer is d", "D", "D", None, None, "D", "D"),
    ("The answer isn't known", None, None, None, None, None, "N/A"),
    ("x = 1,234,567.50", None, None, None, "1234567.50", None, "N/A"),
    ("1,2,3", None, None, None, "3", None, "N/A"),
    ("total 42.", None, None, None, "42.", None, "N/A"),
    ("-5 and 4.2", None, None, None, "4.2", None, "N/A"),
    ("1e3", None, None, None, "1e3", None, "N/A"),
    ("a 3,000 apples, 12", None, None, None, "12", None, "N/A"),
    ("nothing", None, None, None, None, None, "N/A"),
    ("٣ items", None, None, None, "٣", None, "N/A"),
    ("the answer is 7 metres, C", None, None, None, "7", "E", "N/A"),
    ("İ answer: a", "A", "A", None, None, None, "N/A"),
    ("Answers: A", None, None, None, None, None, "N/A"),
    ("answer is: 3-1=2", None, None, None, "2", None, "N/A"),
    (None, None, None, None, None, None, None),
]
RULES = [
    extract.clean_letter,
    extract.last_letter,
    lambda text: extract.last_letter_after(text, 1),
    extract.last_number_text,
    extract.letter_after_phrase,
    extract.strict_letter,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, case[0]) for i, case in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, text string")
    columns = [rule(F.col("text")).alias(f"r{n}") for n, rule in enumerate(RULES)]
    return {row["i"]: row for row in df.select("i", *columns).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(found, i):
    assert tuple(found[i][f"r{n}"] for n in range(len(RULES))) == CASES[i][1:]


@pytest.mark.parametrize(
    "text, number", [("1,234.50", 1234.5), ("42.", 42.0), ("x -.5", -0.5), ("2e3", 2000.0), ("no", None)]
)
def test_number_as_double(spark, text, number):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(extract.last_number(F.col("text"))).first()[0] == number


def test_strict_letter_without_default(spark):
    df = spark.createDataFrame([("nothing",)], "text string")
    assert df.select(extract.strict_letter(F.col("text"), None)).first()[0] is None


def test_whole_texts_are_read(spark, folder):
    """The number rule against a plain regular expression over every document."""
    from quizlake.plans import fixtures

    rows = (
        fixtures.documents(spark, folder)
        .select("text", extract.last_number_text(F.col("text")).alias("number"))
        .collect()
    )
    number = re.compile(r"[-+]?[.]?\d+(?:,\d{3})*\.?\d*(?:[eE][-+]?\d+)?")
    for row in rows:
        hits = number.findall(re.sub(r"(\d),(\d)", r"\1\2", row["text"]))
        assert row["number"] == (hits[-1].replace(",", "") if hits else None)
    assert any(row["number"] for row in rows)


# The plain patterns in Python's spelling, as a check on the faster forms.
def _python(pattern):
    spelled = pattern.replace(fv.SPACE, r"\s").replace(r"\p{Nd}", r"\d")
    return re.compile(spelled, re.IGNORECASE)


def _letters(text):
    return [hit.upper() for hit in _python(fv.LAST_LETTER).findall(text)]


def _clean(text):
    kept = "".join(c for c in text.lower() if c.isspace() or c in "_:()" or unicodedata.category(c)[0] in "LN")
    for pattern in (fv.CLEAN_COLON_LETTER, fv.CLEAN_IS_LETTER):
        hit = _python(pattern).search(kept)
        if hit:
            return hit[1].upper()
    return None


def _after(text):
    _, phrase, tail = text.partition("answer is")
    hit = re.search("[A-E]", tail, re.IGNORECASE) if phrase else None
    return hit and hit[0].upper()


def _number(text):
    hits = re.findall(fv.NUMBER.replace(r"\p{Nd}", r"\d"), re.sub(r"(\d),(\d)", r"\1\2", text))
    return hits[-1].replace(",", "") if hits else None


PIECES = st.sampled_from(
    ["answer", "Answer", "ans", "wer", "is", "correct option is", "correct", " ", " ", "\n", "\xa0", ":", "a"]
    + ["B", "c", "f", "*", "**", "(", ")", "'", "ſ", "é", "1", "20", ",", ".", "e", "E", "+", "-", "٣", "😀", "x"]
)
TEXTS = st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=100, max_size=300)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch=TEXTS)
def test_rules_equal_the_plain_patterns(spark, batch):
    df = spark.createDataFrame([(text,) for text in batch], "t string")
    text = F.col("t")
    rows = df.select(
        "t",
        F.transform(extract.letter_matches(text), F.upper).alias("letters"),
        extract.clean_letter(text).alias("clean"),
        extract.letter_after_phrase(text).alias("after"),
        extract.last_number_text(text).alias("number"),
    ).collect()
    for row in rows:
        wanted = (_letters(row["t"]), _clean(row["t"]), _after(row["t"]), _number(row["t"]))
        assert (row["letters"], row["clean"], row["after"], row["number"]) == wanted, repr(row["t"])


def test_long_runs_of_blanks_are_passed_in_no_time(spark):
    """Time must not grow with the square of a run's length."""
    import time

    from quizlake.functions.prompts import without_closing

    blanks = " " * 200_000
    df = spark.createDataFrame([(f"answer{blanks}x", f"a{blanks}z")], "text string, rationale string").cache()
    df.count()
    started = time.perf_counter()
    row = df.select(extract.last_letter(F.col("text")), without_closing(F.col("rationale"))).first()
    assert row[0] is None and len(row[1]) == 200_002
    assert time.perf_counter() - started < 5
