"""Comparing runs by the parameters in their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions.runnames import run_fields

def with_run_fields(df: DataFrame, run: str = "run", datasets: list[str] | None = None) -> DataFrame:
    """``df`` with the parameters of its run names as columns. Aggregate to runs first."""
    fields = df.withColumn("_fields", run_fields(F.col(run), datasets))
    return fields.select("*", "_fields.*").drop("_fields")


def _counted(run_counts: DataFrame) -> DataFrame:
    """Counts that know of no missing references have none."""
    if "no_reference" in run_counts.columns:
        return run_counts
    return run_counts.withColumn("no_reference", F.lit(0).cast("bigint"))


def leaderboard(run_counts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Totals over every prefix of ``dimensions`` for rows of (dimensions, n, no_reference, hits).

    Rows without a reference are counted in ``n`` and leave the mean, as in ``score_runs``. ``level`` says how many dimensions a row is split by.
    """
    rolled = _counted(run_counts).rollup(*dimensions).agg(
        F.grouping_id().alias("_gid"), F.sum("n").alias("n"), F.sum("no_reference").alias("no_reference"), F.sum("hits").alias("hits")
    )
    # A rolled-up dimension sets a low bit of the grouping id, so the bits count what is left out.
    left_out = F.bit_count("_gid")
    return rolled.select(
        *dimensions,
        (F.lit(len(dimensions)) - left_out).cast("bigint").alias("level"),
        F.col("n").cast("bigint").alias("n"),
        F.col("no_reference").cast("bigint").alias("no_reference"),
        _em(F.col("hits"), F.col("n") - F.col("no_reference")).alias("em"),
    )


def _em(hits: Column, rows: Column) -> Column:
    """Exact match over the rows with a reference, null over none."""
    return F.round(hits / F.nullif(rows, F.lit(0).cast("bigint")).cast("double"), 6)


def by_shots(run_counts: DataFrame, dimensions: list[str], shots: list[str] | None = None) -> DataFrame:
    """One row per combination of ``dimensions``, one column of exact match per shot setting.

    ``shots`` names the settings; one that is not among them, or null, is an error. By default every
    setting in the counts gets a column.
    """
    setting = F.col("shots")
    if shots is not None:
        unlisted = F.concat(F.lit("unlisted shot setting: "), F.coalesce(setting, F.lit("null")))
        setting = F.when(setting.isin(shots), setting).otherwise(F.raise_error(unlisted))
    sums = _counted(run_counts).withColumn("shots", setting).groupBy(*dimensions, "shots").agg(
        F.sum("n").alias("_n"), F.sum("no_reference").alias("_no_reference"), F.sum("hits").alias("_hits")
    )
    value = _em(F.first("_hits"), F.first("_n") - F.first("_no_reference"))
    return sums.groupBy(*dimensions).pivot("shots", shots).agg(value)
