"""Batches of texts of nearly one length, so that padding to the longest wastes little.

Rows are numbered in the order of their length, equal lengths by a seeded hash, and every ``size`` of
them are a batch. Lengths are cut where encoding cuts them, so there are few; a histogram over
(length, stretch of hashes), with as many stretches as keep each near fifty thousand rows, gives each
group its place, and rows are numbered within their group. No task sorts more than a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions.hashing import seeded_hash

#: Rows that one task numbers, about: their texts come along, some kilobytes each.
GROUP_ROWS = 50_000


def length_batches(
    df: DataFrame,
    key: str,
    length: str,
    size: int,
    seed: int = fv.SAMPLE_SEED,
    batch: str = "batch",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``df`` with a ``batch`` number, from 0, of ``size`` rows each in the order of the column ``length``,
    the last one perhaps of fewer. ``key`` must identify a row; ``length`` must have few values."""
    if size < 1:
        raise ValueError("size must be positive")
    hashed = df.withColumn("_hash", seeded_hash(seed, key))
    counts = hashed.groupBy(length).agg(F.count("*").alias("_of_length"))
    stretches = F.greatest(F.lit(1), F.ceil(F.col("_of_length") / group_rows)).cast("bigint")
    # A row per length: bounded by what encoding keeps of a text.
    cut = F.broadcast(counts.select(F.col(length).alias("_length"), stretches.alias("_stretches")))
    number = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint")
    grouped = hashed.join(cut, F.col(length).eqNullSafe(F.col("_length"))).withColumn("_stretch", F.floor(number * F.col("_stretches") / 2**32))
    # A row per group of many thousands: the totals before each are small enough for one task.
    groups = grouped.groupBy("_length", "_stretch").agg(F.count("*").alias("_rows"))
    running = Window.orderBy(F.col("_length").asc_nulls_first(), "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select(F.struct("_length", "_stretch").alias("_group"), F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_before"))
    placed = grouped.withColumn("_group", F.struct("_length", "_stretch")).join(before, "_group")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_group").orderBy("_hash", key)) - 1
    return placed.withColumn(batch, F.floor(rank / size).cast("bigint")).select(*df.columns, batch)


def padding_report(encoded: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows, ids and padding of encoded texts, per group of ``by``: n, and for each text its ids, pads and
    the share of pads."""
    columns = [F.count("*").alias("n")]
    for name in names:
        width, held = F.size(f"{name}_ids"), F.aggregate(f"{name}_mask", F.lit(0), lambda total, x: total + x)
        columns += [
            F.sum(held).cast("bigint").alias(f"{name}_used"),
            F.sum(width - held).cast("bigint").alias(f"{name}_pads"),
            F.round(F.sum(width - held) / F.nullif(F.sum(width), F.lit(0)), 6).alias(f"{name}_padding"),
        ]
    return encoded.groupBy(*(by or [])).agg(*columns)
