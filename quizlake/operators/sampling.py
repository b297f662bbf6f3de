"""Repeatable samples.

A sample is the lowest rows by ``md5(seed:key)``, ties by key, so it depends on (seed, key) only.
Ranks come from a histogram of hash prefixes: one narrow pass counts the rows per prefix, running
totals turn the counts into offsets, and rows are numbered inside their own prefix. Nothing is
sorted in one task, and rows beyond the wanted rank are dropped before any shuffle. ``key`` must
identify a row.

A prefix is the leading zeros of the hash and three digits more, or more than three where a full
ranking of many rows asks for finer groups. Low hashes are thus told apart
more finely than high ones, and the prefix that a cut runs through is small next to the sample,
for ten rows out of a hundred billion as for half of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizlake import fixed_values as fv
from quizlake.functions.hashing import seeded_hash

_HASH_DIGITS = 32
_PREFIX_DIGITS = 3
# Rows that a full ranking sorts in one group, about.
_GROUP_ROWS = 1_000_000


def _digits(rows: int) -> int:
    """Digits that keep the groups of a full ranking near ``_GROUP_ROWS`` rows, three at least."""
    digits = _PREFIX_DIGITS
    while rows > _GROUP_ROWS * 15 * 16 ** (digits - 1):
        digits += 1
    return digits


def _hashed(df: DataFrame, key: str, seed: int, digits: int) -> DataFrame:
    hashed = df.withColumn("_hash", seeded_hash(seed, key))
    zeros = F.lit(_HASH_DIGITS) - F.length(F.ltrim(F.col("_hash"), F.lit("0")))
    return hashed.withColumn("_prefix", F.substring("_hash", F.lit(1), zeros + digits))


def _offsets(hashed: DataFrame, strata: list[str]) -> DataFrame:
    """Rows before each prefix and rows in all, per stratum.

    With three digits a stratum has 3,840 prefixes for each count of leading zeros: some 35,000 rows
    at a hundred billion keys. A full ranking has more digits where groups would grow beyond
    ``_GROUP_ROWS``, and then at most some 20 prefixes per million rows.
    """
    counts = hashed.groupBy(*strata, "_prefix").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*strata)
    before = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *strata,
        "_prefix",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).cast("bigint").alias("_before"),
        F.sum("_rows").over(whole).cast("bigint").alias("_total"),
    )


def _ranked(
    df: DataFrame,
    key: str,
    seed: int,
    strata: list[str],
    wanted: Column | None,
    most: int | None,
    rank: str,
) -> DataFrame:
    """``df`` with its 1-based ``rank`` and ``_total``, cut to rank <= wanted when that is given.

    ``strata`` must be columns with a fixed set of values: the offsets are broadcast.
    """
    # Only a full ranking sorts every group; a cut drops all but one of them beforehand.
    digits = _PREFIX_DIGITS if wanted is not None else _digits(df.count())
    hashed = _hashed(df, key, seed, digits)
    offsets = _offsets(hashed.select(*strata, "_prefix"), strata)
    rows = hashed.join(F.broadcast(offsets), [*strata, "_prefix"])
    if wanted is not None:
        rows = rows.where(F.col("_before") < wanted)
    order = Window.partitionBy(*strata, "_prefix").orderBy("_hash", key)
    rows = rows.withColumn("_in_prefix", F.row_number().over(order))
    if wanted is not None:
        # Implied by the exact cut below; stated so that Spark limits each group before the shuffle.
        # Spark limits groups to int counts only; a larger sample goes without the early limit.
        rows = rows.where(F.col("_in_prefix") <= most) if most < 2**31 else rows
    rows = rows.withColumn(rank, F.col("_before") + F.col("_in_prefix"))
    if wanted is not None:
        rows = rows.where(F.col(rank) <= wanted)
    return rows.drop("_hash", "_prefix", "_before", "_in_prefix")


def seeded_rank(df: DataFrame, key: str, seed: int, rank: str = "rank") -> DataFrame:
    """Full shuffle: every row with its 1-based place in the seeded order."""
    return _ranked(df, key, seed, [], None, None, rank).drop("_total")


def seeded_rank_with_total(df: DataFrame, key: str, seed: int, rank: str, total: str) -> DataFrame:
    """As ``seeded_rank``, with the row count of ``df`` beside each rank."""
    return _ranked(df, key, seed, [], None, None, rank).withColumnRenamed("_total", total)


def sample_uniform(
    df: DataFrame,
    n: int,
    key: str,
    seed: int = fv.SAMPLE_SEED,
    strict: bool = False,
    rank: str = "rank",
) -> DataFrame:
    """``n`` rows without replacement; all rows when there are fewer, an error if ``strict``."""
    if n < 0:
        raise ValueError("n must not be negative")
    if strict and (rows := df.count()) < n:
        raise ValueError(f"{n} rows wanted, {rows} there")
    return _ranked(df, key, seed, [], F.lit(n), n, rank).drop("_total")


def quotas(n: int) -> dict[str, int]:
    """Rows per letter; what does not divide evenly goes to the first letters."""
    each, left = divmod(n, len(fv.LETTERS))
    return {letter: each + (i < left) for i, letter in enumerate(fv.LETTERS)}


def sample_stratified(
    df: DataFrame, n: int, key: str, seed: int, letter: str = "correct", rank: str = "class_rank"
) -> DataFrame:
    """``n`` rows spread evenly over the five letters, with a key to order them by."""
    wanted_rows = quotas(n)
    wanted = F.lit(0)
    for name, rows in wanted_rows.items():
        wanted = F.when(F.col(letter) == name, rows).otherwise(wanted)
    lettered = df.where(F.col(letter).isin(fv.LETTERS))
    picked = _ranked(lettered, key, seed, [letter], wanted, max(wanted_rows.values()), rank)
    return picked.drop("_total").withColumn("shuffle_key", seeded_hash(f"{seed}:mixed", key))


def sample_training(
    df: DataFrame,
    n: int,
    key: str,
    seed: int,
    letter: str = "correct",
    stratified_limit: int = fv.STRATIFIED_LIMIT,
) -> DataFrame:
    """Stratified up to ``stratified_limit`` rows, uniform beyond it."""
    if n <= stratified_limit:
        return sample_stratified(df, n, key, seed, letter).drop("class_rank", "shuffle_key")
    return sample_uniform(df, n, key, seed).drop("rank")


def nested_prefixes(
    df: DataFrame, sizes: list[int], key: str, seed: int, tag: str = "smallest_n"
) -> DataFrame:
    """Rows of the largest subset, each tagged with the smallest subset it is in.

    The subset of size n is ``smallest_n <= n``: smaller subsets lie inside larger ones and all
    come from one ranking.
    """
    ordered = sorted(set(sizes))
    picked = sample_uniform(df, ordered[-1], key, seed)
    smallest = F.lit(ordered[-1])
    for size in reversed(ordered[:-1]):
        smallest = F.when(F.col("rank") <= size, size).otherwise(smallest)
    return picked.withColumn(tag, smallest.cast("bigint"))


def class_balance(df: DataFrame, letter: str = "correct") -> DataFrame:
    """Rows per letter."""
    return df.groupBy(letter).agg(F.count("*").alias("n"))


def balance_report(df: DataFrame, n: int, letter: str = "correct") -> DataFrame:
    """Rows per letter beside the rows a sample of ``n`` should hold; short letters are marked."""
    wanted = F.create_map(*[F.lit(x) for pair in quotas(n).items() for x in pair])
    found = F.create_map(
        *[
            part
            for name in fv.LETTERS
            for part in (F.lit(name), F.count(F.when(F.col(letter) == name, True)))
        ]
    )
    # One row of five counts, so that a letter with no row at all still shows.
    totals = df.agg(found.alias("_found"))
    rows = totals.select(F.explode("_found").alias(letter, "n"))
    return rows.withColumn("wanted", F.element_at(wanted, F.col(letter)).cast("bigint")).withColumn(
        "short", F.col("n") < F.col("wanted")
    )


def first_n(df: DataFrame, n: int, *order: str, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` of an explicit order."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(n)
