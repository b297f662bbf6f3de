"""Reading answers anew out of the replies that a result table holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions.compare import answer_status
from quizlake.operators.scoring import score_sheet
from quizlake.sources.result_table import ResultTable


def reextract(table: ResultTable, extractor: Callable[[Column], Column]) -> None:
    """Replace the table by one whose answers and statuses come from its replies; pending rows stay, and
    so do rows that are appended while this runs."""

    def anew(rows: DataFrame) -> DataFrame:
        waiting = F.col("status") == "pending"
        answer = F.when(~waiting, extractor(F.col("LLMs_rationale")))
        text = F.coalesce("LLMs_rationale", F.lit(""))
        status = F.when(waiting, F.col("status")).otherwise(answer_status(text, F.col("LLMs_answer")))
        return rows.withColumn("LLMs_answer", answer).withColumn("status", status)

    table.update(anew)


def score_table(table: ResultTable, by: list[Column], reference: str = "correct") -> DataFrame:
    """Exact match of a table's answers over the rows that are not pending."""
    rows = table.read().where("status <> 'pending'").select("*", *by)
    names = rows.columns[len(table.schema.names) :]
    return score_sheet(rows, names, "LLMs_answer", reference)


def write_score_sheet(sheet: DataFrame, path: str) -> None:
    """A score sheet as CSV with headers, in as many files as Spark makes of it. Readers of result files
    set its files aside if ``path`` lies among theirs."""
    sheet.write.mode("overwrite").csv(path, header=True)
