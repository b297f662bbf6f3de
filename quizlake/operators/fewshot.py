"""Worked examples for few-shot prompts.

Each question draws ``n_shot`` different rows of the pool, never itself, uniformly and in drawn
order. The draw is arithmetic on places in the pool's seeded order, so it costs one number per
shot. Places turn into keys by a join of narrow rows, and the examples' texts come in by key. Places
are drawn uniformly, so neither join has a hot key, and the cost is linear in the questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions import prompts
from quizlake.functions.hashing import hash_number, seeded_hash
from quizlake.operators.sampling import seeded_rank_with_total


def _drawn_places(n_shot: int, seed: int, key: str, own: Column, total: Column) -> Column:
    """``n_shot`` different places out of ``total``, none of them ``own`` (null: not in the pool)."""
    taken_first = F.when(own.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(own))
    free = total - F.size(taken_first)

    def place(taken: Column, i: Column) -> Column:
        # A number among the places still free, moved up past each taken place at or below it.
        among_free = F.pmod(hash_number(seeded_hash(seed, i, F.col(key))), free - i)
        return F.aggregate(
            F.array_sort(F.concat(taken_first, taken)),
            among_free,
            lambda at, used: at + F.when(at >= used, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        )

    slots = F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.lit(n_shot - 1).cast("bigint")), lambda i: i < free
    )
    return F.aggregate(
        slots,
        F.array().cast("array<bigint>"),
        lambda taken, i: F.concat(taken, F.array(place(taken, i))),
    )


def draw_examples(
    questions: DataFrame,
    n_shot: int,
    key: str = "item_id",
    seed: int = fv.SAMPLE_SEED,
    pool: DataFrame | None = None,
) -> DataFrame:
    """Rows of (key, slot, ex_id), ``n_shot`` per question while the pool has that many others.

    Without ``pool`` the examples come from the questions themselves.
    """
    if n_shot < 1:
        raise ValueError("n_shot must be at least 1")
    source = questions if pool is None else pool
    ranked = seeded_rank_with_total(source.select(key), key, seed, "_rank", "_total")
    placed = ranked.select(key, (F.col("_rank") - 1).alias("_place"), "_total")
    if pool is None:
        own = placed.withColumnRenamed("_place", "_own")
    else:
        total = F.lit(pool.count()).cast("bigint")
        places = placed.select(key, F.col("_place").alias("_own"))
        own = questions.select(key).join(places, key, "left").withColumn("_total", total)
    drawn_places = _drawn_places(n_shot, seed, key, F.col("_own"), F.col("_total"))
    drawn = own.select(key, "_total", F.posexplode(drawn_places).alias("slot", "_place"))
    # The total is the same on every row. It takes part in the join so that both sides need the
    # same columns of the ranking, which Spark then shuffles once for both.
    examples = placed.withColumnRenamed(key, "ex_id")
    return drawn.join(examples, ["_place", "_total"]).select(key, "slot", "ex_id")


def _with_examples(
    questions: DataFrame,
    example: Column,
    n_shot: int,
    key: str,
    seed: int,
    pool: DataFrame | None,
) -> DataFrame:
    source = questions if pool is None else pool
    texts = source.select(F.col(key).alias("ex_id"), example.alias("example"))
    drawn = draw_examples(questions, n_shot, key, seed, pool).join(texts, "ex_id")
    # At most n_shot rows per question, brought back into drawn order.
    blocks = drawn.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("slot", "example"))).alias("_blocks")
    )
    text = F.array_join(F.transform("_blocks", lambda b: b["example"]), "")
    joined = questions.join(blocks, key, "left")
    examples = F.coalesce(text, F.lit(""))
    prompt = prompts.zero_shot(F.col("question"), F.col("options"), examples)
    return joined.withColumn("few_shot_prompt", prompt).drop("_blocks")


def letter_prompts(
    questions: DataFrame,
    n_shot: int,
    key: str = "item_id",
    seed: int = fv.SAMPLE_SEED,
    pool: DataFrame | None = None,
) -> DataFrame:
    """Few-shot prompts whose examples show the letter alone."""
    example = prompts.letter_example(F.col("question"), F.col("options"), F.col("correct"))
    return _with_examples(questions, example, n_shot, key, seed, pool)


def rationale_prompts(
    questions: DataFrame,
    n_shot: int,
    key: str = "item_id",
    seed: int = fv.SAMPLE_SEED,
    pool: DataFrame | None = None,
) -> DataFrame:
    """Few-shot prompts whose examples reason before they answer."""
    example = prompts.rationale_example(
        F.col("question"), F.col("options"), F.col("rationale"), F.col("correct")
    )
    return _with_examples(questions, example, n_shot, key, seed, pool)
