"""The joins that stand in for row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.session import materialise

_SALTS = 64
# Largest table, and largest list of hot keys, to send along with the tasks.
_BROADCAST_BYTES = 32 * 1024 * 1024


def fits(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` holds at most ``limit`` bytes; one aggregation over it."""
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns]
    size = df.agg(F.sum(sum(widths[1:], widths[0])).alias("bytes")).first()["bytes"]
    return (size or 0) <= limit


def attach(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    hot_rows: int | None = 1_000_000,
    broadcast_bytes: int = _BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` to ``table``, which holds each ``key`` once, without one key filling one task.

    A table of at most ``broadcast_bytes`` is broadcast. Beyond it, keys with at least ``hot_rows`` rows
    are found by a map-side combined count over the key column alone; their list, a row per
    ``hot_rows`` rows at most, is written, measured, and broadcast or joined. Rows of a hot key and
    rows without a key are spread over ``_SALTS`` salts and its one table row is repeated per salt,
    so the work of a hot key is split whatever the session's adaptive settings. All other rows
    carry salt 0. The join itself, broadcast or shuffled, is left to Spark's own size check.
    ``how`` is ``inner`` or ``left``; ``rows`` should carry a row id, since rows that are equal in
    every column share a salt.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if hot_rows is None:
        return rows.join(table, key, how)
    if fits(table, broadcast_bytes):
        return rows.join(F.broadcast(table), key, how)
    hot = (
        rows.groupBy(key)
        .agg(F.count("*").alias("_rows"))
        .where((F.col("_rows") >= hot_rows) & F.col(key).isNotNull())
        .select(key, F.lit(True).alias("_hot"))
    )
    hot = materialise(hot, "hot-keys")
    if fits(hot, _BROADCAST_BYTES):
        hot = F.broadcast(hot)
    # The row's own content picks the salt: a rerun of a lost task must give the same one.
    salted = rows.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS))).otherwise(
            F.lit(0).cast("bigint")
        ),
    )
    last_salt = F.when(F.col("_hot"), F.lit(_SALTS - 1)).otherwise(F.lit(0)).cast("bigint")
    repeated = table.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last_salt))
    )
    return salted.drop("_hot").join(repeated.drop("_hot"), [key, "_salt"], how).drop("_salt")


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a row in ``done``. Repeats in ``done`` are combined before the shuffle."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def missing_runs(expected: DataFrame, present: DataFrame, run: str = "run") -> DataFrame:
    """Expected runs that left no row."""
    return pending(expected.select(run).distinct(), present, run)
