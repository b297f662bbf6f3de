"""Preparing item tables: answer columns, option parsing, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.functions import options as opt

_PARSERS = {
    "json": opt.options_from_json,
    "list": opt.options_from_list_text,
    "legacy_quoted": opt.options_from_quotes,
}


def drop_rationale(df: DataFrame, column: str = "rationale") -> DataFrame:
    """Without the human rationale; no change where there is none."""
    return df.drop(column)


def add_answer_columns(df: DataFrame) -> DataFrame:
    """Empty reply columns, status ``pending``."""
    nothing = F.lit(None).cast("string")
    return df.withColumns(
        {"LLMs_rationale": nothing, "LLMs_answer": nothing, "status": F.lit("pending")}
    )


def parse_options(
    df: DataFrame, column: str = "options_json", into: str = "options", mode: str = "json"
) -> DataFrame:
    """Options text to ``array<string>``: ``json``, ``list`` or ``legacy_quoted``."""
    if mode not in _PARSERS:
        raise ValueError(f"mode must be one of {sorted(_PARSERS)}")
    return df.withColumn(into, _PARSERS[mode](F.col(column)))


def add_reason(df: DataFrame, options: str = "options", correct: str = "correct") -> DataFrame:
    """``reason`` column: ``ok`` or what keeps the item from use."""
    return df.withColumn("reason", opt.shape_problem(F.col(options), F.col(correct)))


def split_usable(
    df: DataFrame, options: str = "options", correct: str = "correct"
) -> tuple[DataFrame, DataFrame]:
    """(usable items, quarantined items with their reason)."""
    checked = add_reason(df, options, correct)
    usable = checked.where(F.col("reason") == "ok").drop("reason")
    return usable, checked.where(F.col("reason") != "ok")


def add_correct_text(df: DataFrame, into: str = "answer_text") -> DataFrame:
    return df.withColumn(into, opt.option_of_letter(F.col("options"), F.col("correct")))
