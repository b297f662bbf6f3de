"""Comparing a prediction with its reference, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions.extract import last_number_text


def normalised(text: Column) -> Column:
    """Lower case without ASCII punctuation."""
    return F.translate(F.lower(text), fv.PUNCTUATION, "")


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def reference_number(answer: Column) -> Column:
    """Number in a worked answer; ``None`` as text when it holds none, so it matches nothing."""
    return F.when(answer.isNotNull(), F.coalesce(last_number_text(answer), F.lit("None")))


def is_valid(answer: Column) -> Column:
    """Answered and readable."""
    return answer.isNotNull() & (answer != fv.UNPARSED)


def is_pending(answer: Column) -> Column:
    return answer.isNull()


def is_nonempty(prediction: Column) -> Column:
    return F.coalesce(F.length(prediction) > 0, F.lit(False))


def first_character(prediction: Column) -> Column:
    return F.substring(prediction, 1, 1)


def exact(prediction: Column, reference: Column) -> Column:
    """1 or 0; two missing values are equal."""
    return F.when(prediction.eqNullSafe(reference), 1).otherwise(0)


def verdict(prediction: Column, reference: Column) -> Column:
    same = F.upper(prediction).eqNullSafe(F.upper(reference))
    return F.when(same, "Correct").otherwise("Incorrect")


def answer_status(response: Column, answer: Column) -> Column:
    """``pending``, ``answered`` or ``unparsed``."""
    return (
        F.when(response.isNull(), "pending")
        .when(is_valid(answer), "answered")
        .otherwise("unparsed")
    )


def as_fraction(score: Column) -> Column:
    return F.round(score, 4)


def as_percent(score: Column) -> Column:
    return F.round(score * 100, 2)
