"""Texts to fixed-length id arrays over a word vocabulary.

A vocabulary of checked size becomes a literal: its words, spread over small maps by hash, so that
encoding is a projection without a join or a shuffle. A larger one is joined to the words instead.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quizlake import fixed_values as fv
from quizlake.operators.batches import length_batches
from quizlake.operators.joins import attach
from quizlake.session import materialise

# Largest vocabulary to send along with the tasks.
_LITERAL_BYTES = 4 * 1024 * 1024
_WORDS_PER_MAP = 8
_SALTS = 32


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.filter(F.split(text, fv.TOKEN_SEPARATOR), lambda word: word != "")


def build_vocabulary(df: DataFrame, text: str, size: int) -> DataFrame:
    """(token, n, token_id) of the ``size`` most frequent words, ties in word order.

    Words are counted on the map side before they are shuffled, so a very common word costs one
    row per task.
    """
    words = df.select(F.explode(F.split(text, fv.TOKEN_SEPARATOR)).alias("token")).where("token <> ''")
    counted = materialise(words.groupBy("token").agg(F.count("*").alias("n")), "counts")
    # The count at which the size is reached, from how many words have each count.
    per_count = counted.groupBy("n").agg(F.count("*").alias("_words"))
    above = F.sum("_words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    reached = per_count.withColumn("_above", F.coalesce(above, F.lit(0))).where(F.col("_above") < size)
    cut = reached.agg(F.min("n")).first()[0]
    kept = counted.where(F.col("n") >= (cut or 0))
    # Words that tie at the cut may be many: ranges of the order are numbered apart and lined up.
    order = [F.desc("n"), "token"]
    placed = kept.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "token", "n", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("_place")
    )
    placed = materialise(placed, "vocabulary")
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.col("_place")
    numbered = placed.join(F.broadcast(starts), "_range").where(rank < size)
    return numbered.select("token", "n", (rank + fv.FIRST_TOKEN_ID).cast("bigint").alias("token_id"))


def _measure(vocabulary: DataFrame) -> tuple[int, int]:
    """Words and bytes."""
    size = F.coalesce(F.sum(F.octet_length("token") + 16), F.lit(0))
    return tuple(vocabulary.agg(F.count("*"), size).first())


def _cut(name: str, length: int) -> Column:
    """The first ``length`` words of a text that is split already; none for a null text."""
    return F.coalesce(F.slice(name, 1, length), F.array().cast("array<string>"))


def _as_literal(vocabulary: DataFrame, size: int) -> Column:
    """The vocabulary as an array of ``size`` small maps; a word is in the map of its hash."""
    place = F.pmod(F.xxhash64("token"), F.lit(size)).alias("place")
    maps: list[dict[str, int]] = [{} for _ in range(size)]
    for row in vocabulary.select("token", "token_id", place).collect():
        maps[row["place"]][row["token"]] = row["token_id"]
    # Written as one text that Spark parses once, when it folds constants.
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def _ids_by_literal(
    split: DataFrame, lengths: dict[str, int], vocabulary: DataFrame, words: int
) -> DataFrame:
    size = max(1, words // _WORDS_PER_MAP)
    maps = _as_literal(vocabulary, size)

    def token_id(token: Column) -> Column:
        own_map = F.get(maps, F.pmod(F.xxhash64(token), F.lit(size)).cast("int"))
        return F.coalesce(F.try_element_at(own_map, token), F.lit(fv.UNKNOWN_ID))

    return split.withColumns(
        {name: F.transform(_cut(name, length), token_id) for name, length in lengths.items()}
    )


def _placed(name: str, field: int, length: int) -> Column:
    """The words kept of a text with their places, marked with their field."""
    return F.transform(
        _cut(name, length),
        lambda token, i: F.struct(F.lit(field).alias("_field"), i.alias("_pos"), token.alias("token")),
    )


def _ids_of(field: int) -> Column:
    own = F.filter("_ids", lambda word: word["_field"] == field)
    return F.transform(own, lambda word: word["id"])


def _ids_by_join(
    split: DataFrame, lengths: dict[str, int], vocabulary: DataFrame, group: list[str]
) -> DataFrame:
    """Words spread into rows, joined to the vocabulary and brought back together.

    Common words hold a large share of the rows, so every word is spread over salts.
    """
    placed = [_placed(name, field, length) for field, (name, length) in enumerate(lengths.items())]
    # inline_outer keeps a row for texts without words.
    words = split.select(*group, F.inline_outer(F.concat(*placed)))
    salted = words.withColumn("_salt", F.pmod(F.col("_pos"), F.lit(_SALTS)))
    salts = F.sequence(F.lit(0), F.lit(_SALTS - 1))
    spread = vocabulary.select("token", "token_id").withColumn("_salt", F.explode(salts))
    numbered = salted.join(spread, ["token", "_salt"], "left")
    token_id = F.coalesce(F.col("token_id"), F.lit(fv.UNKNOWN_ID)).cast("int")
    # A group is one row of ``split``: its size is bounded by the lengths.
    one = F.when(F.col("_pos").isNotNull(), F.struct("_field", "_pos", token_id.alias("id")))
    grouped = numbered.groupBy(*group).agg(F.array_sort(F.collect_list(one)).alias("_ids"))
    ids = {name: _ids_of(field) for field, name in enumerate(lengths)}
    return grouped.withColumns(ids).drop("_ids")


def encode(
    df: DataFrame,
    key: str,
    lengths: dict[str, int],
    vocabulary: DataFrame,
    padding: str = "max_length",
    batch: str | None = None,
    literal_bytes: int = _LITERAL_BYTES,
    batch_size: int | None = None,
) -> DataFrame:
    """One row per row of ``df``: its ``key``, and for each text column ``t`` of ``lengths`` its ``t_ids``, ``t_mask``,
    ``t_tokens`` (words in the whole text) and ``t_cut`` (whether it was longer than its length).

    Ids are cut to the given length and padded on the right: to that length, or with
    ``padding='longest'`` to the longest text of the row's ``batch``. Without a batch column of the
    caller's, ``batch_size`` puts texts of nearly one length together, by the first of ``lengths``;
    ``key`` must identify a row then, and the result has a ``batch`` column.
    """
    if padding not in ("max_length", "longest"):
        raise ValueError("padding must be 'max_length' or 'longest'")
    if (padding == "longest") != ((batch is None) != (batch_size is None)):
        raise ValueError("padding='longest' goes with a batch column or a batch size")
    if batch_size is not None:
        batch = "batch"
        name, length = next(iter(lengths.items()))
        counted = df.select(key, *lengths, F.least(F.coalesce(F.size(tokens(F.col(name))), F.lit(0)), F.lit(length)).alias("_kept"))
        df = length_batches(counted, key, "_kept", batch_size, batch=batch)
    carried = [key] + ([batch] if batch else [])
    group = [*carried, *[f"{name}_tokens" for name in lengths]]

    ids = materialise(vocabulary.select("token", "token_id"), "vocabulary")
    split = df.select(*carried, *[tokens(F.col(name)).alias(name) for name in lengths])
    split = split.withColumns(
        {
            f"{name}_tokens": F.coalesce(F.size(name), F.lit(0)).cast("bigint")
            for name in lengths
        }
    )
    words, size = _measure(ids)
    if size <= literal_bytes:
        numbered = _ids_by_literal(split, lengths, ids, words)
    else:
        # Keys may be null or repeat, so words come back together by a row number of their own; it is
        # written with them, for a lost task would number anew.
        cut = split.withColumns({name: _cut(name, length) for name, length in lengths.items()})
        cut = materialise(cut.withColumn("_row", F.monotonically_increasing_id()), "words")
        numbered = _ids_by_join(cut, lengths, ids, ["_row", *group])

    if padding == "longest":
        # From the word counts alone, so that nothing is encoded for it.
        longest = split.groupBy(batch).agg(
            *[
                F.max(F.least(F.col(f"{name}_tokens"), F.lit(length))).cast("int").alias(f"_{name}_longest")
                for name, length in lengths.items()
            ]
        )
        numbered = attach(numbered, longest, batch)
        widths = {name: F.col(f"_{name}_longest") for name in lengths}
    else:
        widths = {name: F.lit(length) for name, length in lengths.items()}
    out = list(carried)
    for name, length in lengths.items():
        filled = F.size(name)
        missing = widths[name] - filled
        out += [
            F.concat(name, F.array_repeat(F.lit(fv.PAD_ID), missing)).alias(f"{name}_ids"),
            F.concat(
                F.array_repeat(F.lit(1), filled), F.array_repeat(F.lit(0), missing)
            ).alias(f"{name}_mask"),
            F.col(f"{name}_tokens"),
            (F.col(f"{name}_tokens") > length).alias(f"{name}_cut"),
        ]
    return numbered.select(*out)


def truncation_report(df: DataFrame, by: list[str], text: str, length: int) -> DataFrame:
    """Texts, texts longer than ``length`` words, words lost and the longest text, per group."""
    counted = df.select(*by, F.size(tokens(F.col(text))).cast("bigint").alias("_words"))
    over = F.col("_words") > length
    return counted.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(over).alias("n_cut"),
        F.sum(F.when(over, F.col("_words") - length).otherwise(0)).cast("bigint").alias("words_lost"),
        F.max("_words").alias("longest"),
    )
