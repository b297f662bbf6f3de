"""Annotation queries, with the stand-in responder."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions import prompts
from quizlake.functions.extract import last_letter
from quizlake.operators import annotate as ann
from quizlake.operators import evaluation, scoring
from quizlake.plans import fixtures as fx
from quizlake.plans import oracle_views as ov
from quizlake.plans import samples
from quizlake.plans.registry import register
from quizlake.session import materialise, scratch_path
from quizlake.sources.result_table import ResultTable

_TARGET = 1000
_RUNS = ["base", "tuned"]


def _prompted(spark: SparkSession, folder: str) -> DataFrame:
    prompt = prompts.teacher_mcq(F.col("question"), F.col("options"))
    return fx.mcq(spark, folder).withColumn("prompt", prompt)


_LETTERED = " || ', ' || ".join(
    f"'{letter}: ' || options[{j}]" for j, letter in enumerate(fv.LETTERS, 1)
)
_PROMPTED = f"""
    SELECT *, question || chr(10) || chr(10) || 'Options: ' || {_LETTERED} AS prompt FROM mcq"""


def _reply_sql(prompt: str) -> str:
    letter = f"chr(CAST(65 + CAST('0x' || substr(md5({prompt}), 2, 1) AS INTEGER) % 5 AS INTEGER))"
    return (
        f"CASE WHEN substr(md5({prompt}), 1, 1) IN ('0', '1') THEN 'I cannot tell'"
        f" ELSE 'Step one.' || chr(10) || 'Answer: ' || {letter} END"
    )


@register(
    "annotate_batch",
    ov.query(
        f"""
        SELECT item_id, {_reply_sql('prompt')} AS response, CAST(NULL AS VARCHAR) AS error,
               CAST(1 AS BIGINT) AS attempts
        FROM prompted""",
        "mcq",
        prompted=_PROMPTED,
    ),
)
def annotate_batch(spark: SparkSession, folder: str) -> DataFrame:
    return ann.annotate(_prompted(spark, folder), ann.template_responder, ["item_id"])


@register(
    "annotate_until_target",
    ov.query(
        f"""
        SELECT item_id, {ov.last_letter('response')} AS LLMs_answer, 'answered' AS status,
               row_number() OVER (ORDER BY {ov.seeded(fv.SAMPLE_SEED, 'item_id')}, item_id) AS rank
        FROM replied WHERE {ov.last_letter('response')} IS NOT NULL
        ORDER BY {ov.seeded(fv.SAMPLE_SEED, 'item_id')}, item_id LIMIT {_TARGET}""",
        "mcq",
        prompted=_PROMPTED,
        replied=f"SELECT *, {_reply_sql('prompt')} AS response FROM prompted WHERE item_id % 7 <> 0",
    ),
)
def annotate_until_target(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds of asking until a thousand items have a valid answer; one item in seven has no prompt."""
    items = _prompted(spark, folder).withColumn("prompt", F.when(F.col("item_id") % 7 != 0, F.col("prompt")))
    table = ResultTable(spark, scratch_path(spark, "annotated")).create()
    done = ann.annotate_until(
        items, table, ann.template_responder, last_letter, _TARGET
    )
    return done.select("item_id", "LLMs_answer", "status", "rank")


@register(
    "generate_and_score",
    ov.query(
        f"""
        SELECT run, count(*) AS n, count(pred) AS answered, CAST(0 AS BIGINT) AS blank,
               CAST(0 AS BIGINT) AS no_reference,
               round(avg(CASE WHEN pred = correct THEN 1.0 ELSE 0.0 END), 6) AS em
        FROM (SELECT *, {ov.last_letter('response')} AS pred FROM replied) GROUP BY run""",
        "mcq",
        prompted=_PROMPTED,
        asked=f"SELECT *, unnest({_RUNS}) AS run FROM prompted",
        replied=f"SELECT *, {_reply_sql('run || chr(10) || prompt')} AS response FROM asked",
    ),
)
def generate_and_score(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs asked and scored in one job."""
    items = _prompted(spark, folder)
    asked = ann.annotate_runs(items, _RUNS, ann.template_responder)
    # Written before they are scored: a lost task must not ask again.
    replies = materialise(asked, "replies")
    return scoring.score_runs(replies, items, ["run"])


_MODES = [("zero_shot", 0), ("letter", 2), ("rationale", 2)]


def _few_shot_sql(mode: str, example: str) -> str:
    return f"""
        SELECT s.item_id, '{mode}' AS mode, 2 AS n_shot, {example.format('a.')} || {example.format('b.')} || {samples._OPEN.format('s.')} AS prompt
        FROM second s JOIN placed a ON a.own = place0 JOIN placed b ON b.own = place1"""


@register(
    "generate_and_score_modes",
    ov.query(
        f"""
        SELECT run, mode, n_shot, count(*) AS n, count(pred) AS answered, CAST(0 AS BIGINT) AS blank,
               CAST(0 AS BIGINT) AS no_reference,
               round(avg(CASE WHEN pred = correct THEN 1.0 ELSE 0.0 END), 6) AS em
        FROM (SELECT r.run, r.mode, r.n_shot, m.correct, {ov.last_letter_after('r.response', 'r.n_shot')} AS pred
              FROM replied r JOIN mcq m USING (item_id)) GROUP BY ALL""",
        "mcq",
        **samples._DRAWS,
        prompted=f"""
            SELECT item_id, 'zero_shot' AS mode, 0 AS n_shot, {samples._OPEN.format('')} AS prompt FROM mcq
            UNION ALL {_few_shot_sql('letter', samples._LETTER)}
            UNION ALL {_few_shot_sql('rationale', samples._REASONED)}""",
        asked=f"SELECT *, unnest({_RUNS}) AS run FROM prompted",
        replied=f"SELECT *, prompt || {_reply_sql('run || chr(10) || prompt')} AS response FROM asked",
    ),
)
def generate_and_score_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs in three prompt modes, asked in one job by a responder that repeats the prompt, and scored."""
    echoing = partial(ann.template_responder, echo=True)
    return evaluation.generate_and_score(fx.mcq(spark, folder), _RUNS, _MODES, echoing)
