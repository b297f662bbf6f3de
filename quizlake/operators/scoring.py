"""Exact-match scores.

Replies meet the references of their items in one of two ways. References of checked, small size are
broadcast and the replies stay where they are. Otherwise equal replies are combined on the map side
before the join, so that an item or a run holding a large share of the rows shrinks to a few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions import compare
from quizlake.functions.extract import last_letter, last_letter_after, last_number_text
from quizlake.operators.joins import attach, fits

_PLACES = 6
_BROADCAST_BYTES = 32 * 1024 * 1024


def mean_score(hits: Column) -> Column:
    """Mean of a 0/1 column, rounded so that summation order does not show."""
    return F.round(F.avg(hits), _PLACES)


def grade_letters(
    responses: DataFrame,
    shots: str | int | None = None,
    response: str = "response",
    into: str = "pred",
) -> DataFrame:
    """Letter of each reply: the last one, or with ``shots`` the last one past the examples."""
    text = F.col(response)
    if shots is None:
        letter = last_letter(text)
    else:
        letter = last_letter_after(text, F.col(shots) if isinstance(shots, str) else shots)
    return responses.withColumn(into, letter)


def tally(df: DataFrame, columns: list[str], weight: str = "_n") -> DataFrame:
    """Equal rows combined to one, with their number; done before a join, it disarms hot keys."""
    return df.groupBy(*columns).agg(F.count("*").alias(weight))


def with_reference(
    answers: DataFrame,
    items: DataFrame,
    columns: list[str],
    key: str = "item_id",
    weight: str = "_n",
    broadcast_bytes: int = _BROADCAST_BYTES,
) -> DataFrame:
    """Answers with ``columns`` of their items and, in ``weight``, how many rows each row stands for.

    Answers without an item are kept. Only for use in aggregates: equal answers may be combined.
    """
    reference = items.select(key, *columns)
    if fits(reference, broadcast_bytes):
        one = answers.withColumn(weight, F.lit(1).cast("bigint"))
        return one.join(F.broadcast(reference), key, "left")
    return tally(answers, answers.columns, weight).join(reference, key, "left")


def run_counts(
    responses: DataFrame,
    items: DataFrame,
    by: list[str],
    shots: str | int | None = None,
    key: str = "item_id",
    broadcast_bytes: int = _BROADCAST_BYTES,
) -> DataFrame:
    """Rows per run: ``n``, ``answered``, ``blank``, ``no_reference`` and ``hits``."""
    graded = grade_letters(responses, shots).select(
        *by, key, "pred", F.col("response").isNull().alias("_blank")
    )
    joined = with_reference(graded, items, ["correct"], key, "_n", broadcast_bytes)
    known = F.col("correct").isNotNull()
    hit = known & F.col("pred").eqNullSafe(F.col("correct"))
    return joined.groupBy(*by).agg(
        _rows("_n").alias("n"),
        _rows("_n", F.col("pred").isNotNull()).alias("answered"),
        _rows("_n", F.col("_blank")).alias("blank"),
        _rows("_n", ~known).alias("no_reference"),
        _rows("_n", hit).alias("hits"),
    )


def score_runs(
    responses: DataFrame,
    items: DataFrame,
    by: list[str],
    shots: str | int | None = None,
    key: str = "item_id",
    broadcast_bytes: int = _BROADCAST_BYTES,
) -> DataFrame:
    """One row per run: rows, answered, blank, without item, and the exact-match mean.

    An unreadable or blank reply scores 0 and stays in the mean. Rows whose item has no reference
    letter leave the mean and are counted in ``no_reference``.
    """
    counts = run_counts(responses, items, by, shots, key, broadcast_bytes)
    em = share(F.col("hits"), F.col("n") - F.col("no_reference"))
    return counts.withColumn("em", em).drop("hits")


def row_verdicts(
    responses: DataFrame,
    items: DataFrame,
    extractor: Callable[[Column], Column],
    key: str = "item_id",
) -> DataFrame:
    """Each reply with its answer, its reference letter and ``Correct`` or ``Incorrect``."""
    graded = responses.withColumn("pred", extractor(F.col("response")))
    joined = attach(graded, items.select(key, "correct"), key, "left")
    return joined.withColumn("verdict", compare.verdict(F.col("pred"), F.col("correct")))


def _rows(weight: str | None, condition: Column | None = None) -> Column:
    """Rows of a group that meet ``condition``.

    ``weight`` names a column that says how many rows each row stands for, for rows combined before
    a join.
    """
    one = F.lit(1) if weight is None else F.col(weight)
    counted = one if condition is None else F.when(condition, one).otherwise(0)
    return F.sum(counted).cast("bigint")


def share(hits: Column, rows: Column) -> Column:
    """``hits / rows``, null over no rows, rounded so that summation order does not show."""
    return F.round(hits / F.nullif(rows, F.lit(0).cast("bigint")).cast("double"), _PLACES)


def score_sheet(
    df: DataFrame,
    by: list[str],
    pred: str,
    ref: str,
    mode: str = "default",
    normalise: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Exact match over rows that carry both prediction and reference.

    ``default``: null predictions score 0, null references leave the mean. ``legacy``: both turn
    into empty text first, so two missing values match. ``nullsafe``: missing values are kept and
    two of them match.
    """
    if mode not in ("default", "legacy", "nullsafe"):
        raise ValueError("mode must be 'default', 'legacy' or 'nullsafe'")
    prediction, reference = F.col(pred), F.col(ref)
    known = F.lit(True) if mode != "default" else reference.isNotNull()
    if mode == "legacy":
        prediction = compare.text_or_empty(prediction)
        reference = compare.text_or_empty(reference)
    if normalise:
        prediction, reference = compare.normalised(prediction), compare.normalised(reference)
    hit = known & (compare.exact(prediction, reference) == 1)
    return df.groupBy(*by).agg(
        _rows(weight).alias("n"),
        _rows(weight, compare.is_valid(F.col(pred))).alias("answered"),
        _rows(weight, ~known).alias("no_reference"),
        share(_rows(weight, hit), _rows(weight, known)).alias("em"),
    )


def score_numeric(df: DataFrame, by: list[str], response: str, answer: str) -> DataFrame:
    """Exact match of last numbers, both as normalised text and strictly as doubles."""
    pred = last_number_text(F.col(response))
    ref = compare.reference_number(F.col(answer))
    rows = df.select(*by, pred.alias("_pred"), ref.alias("_ref"))
    known = F.col("_ref").isNotNull()
    same_text = compare.exact(
        compare.normalised(compare.text_or_empty(F.col("_pred"))), compare.normalised(F.col("_ref"))
    )
    pred_value, ref_value = F.col("_pred").try_cast("double"), F.col("_ref").try_cast("double")
    same_value = F.when(pred_value == ref_value, 1).otherwise(0)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count("_pred").alias("answered"),
        F.count(F.when(~known, True)).alias("no_reference"),
        mean_score(F.when(known, same_text)).alias("em"),
        mean_score(F.when(known, same_value)).alias("em_strict"),
    )


def text_accuracy(
    df: DataFrame, by: list[str], pred: str, answer: str, weight: str | None = None
) -> DataFrame:
    """Share of predictions equal to the option text, case and all; null over no rows."""
    hits = _rows(weight, F.col(pred) == F.col(answer))
    return df.groupBy(*by).agg(
        _rows(weight).alias("n"), share(hits, _rows(weight)).alias("accuracy")
    )


def valid_counts(df: DataFrame, by: list[str], answer: str) -> DataFrame:
    """Valid, unparsed and pending answers."""
    value = F.col(answer)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(compare.is_valid(value)).alias("valid"),
        F.count_if(compare.is_pending(value)).alias("pending"),
    )


def first_letters(df: DataFrame, pred: str, weight: str | None = None) -> DataFrame:
    """How often each first character occurs among non-empty predictions."""
    value = F.col(pred)
    return (
        df.where(compare.is_nonempty(value))
        .groupBy(compare.first_character(value).alias("letter"))
        .agg(_rows(weight).alias("n"))
    )
