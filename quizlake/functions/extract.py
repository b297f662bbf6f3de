"""Answers out of free text: seven rules, each one a Catalyst expression.

All of them read the whole text and give null when nothing is found, but for ``strict_letter``
with its text default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizlake import fixed_values as fv

_ANY_CASE = "(?iu)"

# The rules below find what the plain patterns of fixed_values find, in forms that a regex engine
# gets through several times as fast.

# LAST_LETTER with its first letters drawn to the front, so that the scan for a start is on one
# character class, and with possessive blanks, so that a long run of them is passed once.
_BLANKS = rf"{fv.SPACE}*+"
_LAST_LETTER = (
    rf"[ac](?:(?<=a)nswer(?:{fv.SPACE}++is)?+|(?<=c)orrect{fv.SPACE}++option{fv.SPACE}++is)"
    rf"{_BLANKS}(?::{_BLANKS})?+([A-E])"
)


def _through_junk(word: str) -> str:
    """A word with anything between its letters that cleaning would delete."""
    return f"{fv.NOT_WORD_SPACE_COLON_BRACKET}*".join(word)


# CLEAN_COLON_LETTER and CLEAN_IS_LETTER on the text as it is, deletable characters passed over.
_JUNK_OR_SPACE = r"[^\p{L}\p{N}_:()]"
_SPACES = rf"{fv.NOT_WORD_SPACE_COLON_BRACKET}*{fv.SPACE}{_JUNK_OR_SPACE}*"
_CLEAN_COLON = rf"{_through_junk('answer')}{_JUNK_OR_SPACE}*:{_JUNK_OR_SPACE}*([a-e])"
_CLEAN_IS = rf"{_through_junk('answer')}{_SPACES}{_through_junk('is')}{_SPACES}([a-e])"

_AFTER_PHRASE = rf"{fv.AFTER_PHRASE}[^A-Ea-e]*+([A-Ea-e])"

# No number reaches beyond a run of these characters, so the last run with a digit holds the last
# number. The run is looked for from the end of the text.
_DIGIT = r"\p{Nd}"
_IN_NUMBER = r"[-+.,eE\p{Nd}]"
_LAST_RUN = rf"(?s)^(?:.*[^-+.,eE\p{{Nd}}])?({_IN_NUMBER}*\p{{Nd}}{_IN_NUMBER}*)"


def _group(text: Column, pattern: str) -> Column:
    """First group of the first match, empty text for none."""
    return F.regexp_extract(text, pattern, 1)


def _found(group: Column) -> Column:
    return F.nullif(group, F.lit(""))


def letter_matches(text: Column) -> Column:
    """Every answer letter in the text, in order."""
    return F.regexp_extract_all(text, F.lit(_ANY_CASE + _LAST_LETTER), 1)


def last_letter(text: Column) -> Column:
    """The last answer letter."""
    return F.upper(F.try_element_at(letter_matches(text), F.lit(-1)))


def last_letter_after(text: Column, shots: Column | int) -> Column:
    """The last answer letter of a reply that repeats ``shots`` worked examples before answering.

    The letters of the examples do not count: with no letter beyond them there is no answer.
    """
    shots = F.lit(shots) if isinstance(shots, int) else shots
    beyond = F.slice(letter_matches(text), shots.cast("int") + 1, F.lit(2**31 - 1))
    return F.upper(F.try_element_at(beyond, F.lit(-1)))


def clean_letter(text: Column) -> Column:
    """First letter after ``answer:``, else after ``answer is``, in lower-cased, stripped text."""
    lowered = F.lower(text)
    after_colon = _found(_group(lowered, _ANY_CASE + _CLEAN_COLON))
    after_is = _group(lowered, _ANY_CASE + _CLEAN_IS)
    # One outer _found, so that the second search is run once and only where the first one failed.
    return F.upper(_found(F.coalesce(after_colon, after_is)))


def letter_after_phrase(text: Column) -> Column:
    """First A-E, of either case and anywhere, behind the first ``answer is``."""
    return F.upper(_found(_group(text, _AFTER_PHRASE)))


def strict_letter(text: Column, default: str | None = fv.UNPARSED) -> Column:
    """Letter of the one prescribed closing sentence, ``default`` where a text has none; null for null."""
    letter = F.upper(_found(_group(text, _ANY_CASE + fv.STRICT_PHRASE)))
    return letter if default is None else F.when(text.isNotNull(), F.coalesce(letter, F.lit(default)))


def last_number_text(text: Column) -> Column:
    """The last number as written, without its thousands commas."""
    joined = F.regexp_replace(_group(text, _LAST_RUN), fv.DIGIT_COMMA_DIGIT, "$1$2")
    numbers = F.regexp_extract_all(joined, F.lit(fv.NUMBER), 0)
    number = F.replace(F.try_element_at(numbers, F.lit(-1)), F.lit(","), F.lit(""))
    # Looking for a digit is the fastest way to pass over texts without one.
    return F.when(text.rlike(_DIGIT), number)


def last_number(text: Column) -> Column:
    """The last number as a double."""
    return last_number_text(text).try_cast("double")
