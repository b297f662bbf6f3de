"""Generating and scoring runs in every prompt mode at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions import prompts
from quizlake.operators import fewshot, scoring
from quizlake.operators.annotate import Responder, annotate
from quizlake.session import materialise

#: Prompt modes: without examples, with examples that show the letter, and with such that reason first.
MODES = ("zero_shot", "letter", "rationale")


def mode_prompts(
    items: DataFrame,
    modes: list[tuple[str, int]],
    key: str = "item_id",
    seed: int = fv.SAMPLE_SEED,
    pool: DataFrame | None = None,
) -> DataFrame:
    """(key, mode, n_shot, prompt) of every item in each of ``modes``, pairs of a mode and its number of
    examples. Without ``pool`` the examples come from the items themselves."""
    out = None
    for mode, n_shot in modes:
        if mode not in MODES or (mode == "zero_shot") != (n_shot == 0):
            raise ValueError(f"no mode {mode} with {n_shot} examples")
        if mode == "zero_shot":
            rows = items.withColumn("few_shot_prompt", prompts.zero_shot(F.col("question"), F.col("options")))
        else:
            made = fewshot.letter_prompts if mode == "letter" else fewshot.rationale_prompts
            rows = made(items, n_shot, key, seed, pool)
        rows = rows.select(key, F.lit(mode).alias("mode"), F.lit(n_shot).alias("n_shot"), F.col("few_shot_prompt").alias("prompt"))
        out = rows if out is None else out.union(rows)
    return out


def generate_and_score(
    items: DataFrame,
    runs: list[str],
    modes: list[tuple[str, int]],
    make_responder: Callable[[], Responder],
    key: str = "item_id",
    seed: int = fv.SAMPLE_SEED,
    pool: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The score sheet of every run in every mode, from one pass of the responder.

    The responder gets prompts and run names, as in ``annotate_runs``, and may repeat the prompt in its
    reply: letters up to the mode's number of examples are passed over. Replies are written before
    they are scored, so that a lost task does not ask again.
    """
    names = F.explode(F.array(*[F.lit(run) for run in runs]))
    asked = mode_prompts(items, modes, key, seed, pool).withColumn("run", names)
    replies = annotate(asked, make_responder, ["run", "mode", "n_shot", key], "prompt", beside="run", **options)
    return scoring.score_runs(materialise(replies, "replies"), items, ["run", "mode", "n_shot"], shots="n_shot", key=key)
