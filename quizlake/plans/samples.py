"""Sampling and few-shot queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.operators import fewshot, sampling
from quizlake.plans import fixtures as fx
from quizlake.plans import oracle_views as ov
from quizlake.plans.registry import register
from quizlake.session import scratch_path
from quizlake.sources.sample_store import SampleStore

_SEED = fv.SAMPLE_SEED
_ORDER = f"{ov.seeded(_SEED, 'item_id')}, item_id"
_QUOTAS = sampling.quotas(fv.STRATIFIED_LIMIT - 2)
_QUOTA_SQL = "CASE correct " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _QUOTAS.items()) + " END"
_STRATIFIED = f"""
    SELECT * FROM (SELECT item_id, correct,
                          row_number() OVER (PARTITION BY correct ORDER BY {_ORDER}) AS class_rank
                   FROM mcq) WHERE class_rank <= {_QUOTA_SQL}"""


def _stratified(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_stratified(
        fx.mcq(spark, folder), fv.STRATIFIED_LIMIT - 2, "item_id", _SEED
    )


@register(
    "sample_stratified",
    ov.query(
        f"SELECT *, {ov.seeded(f'{_SEED}:mixed', 'item_id')} AS shuffle_key FROM picked",
        "mcq",
        picked=_STRATIFIED,
    ),
)
def sample_stratified(spark: SparkSession, folder: str) -> DataFrame:
    """1,028 items, evenly over the letters, the three left over going to A, B and C."""
    return _stratified(spark, folder).select("item_id", "correct", "class_rank", "shuffle_key")


@register("sample_grown", ov.query("SELECT item_id, correct FROM picked", "mcq", picked=_STRATIFIED))
def sample_grown(spark: SparkSession, folder: str) -> DataFrame:
    """The same sample, kept while the kinds of items come in one after another."""
    store = SampleStore(spark, scratch_path(spark, "sample"), fv.STRATIFIED_LIMIT // 5, "item_id", _SEED)
    items = fx.mcq(spark, folder).select("item_id", "correct", "kind")
    for part in ("kind < 'medium'", "kind >= 'medium' and kind < 'small'", "kind >= 'small'"):
        store.update(items.where(part))
    return store.sample(fv.STRATIFIED_LIMIT - 2).select("item_id", "correct")


@register(
    "class_balance",
    ov.query("SELECT correct, count(*) AS n FROM picked GROUP BY 1", "mcq", picked=_STRATIFIED),
)
def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.class_balance(_stratified(spark, folder))


@register(
    "balance_report",
    ov.query(
        """
        SELECT letter AS correct, count(item_id) AS n, any_value(wanted) AS wanted,
               count(item_id) < any_value(wanted) AS short
        FROM quotas LEFT JOIN picked ON letter = correct GROUP BY letter""",
        "mcq",
        picked=_STRATIFIED,
        quotas="SELECT * FROM (VALUES "
        + ", ".join(f"('{k}', CAST({n} AS BIGINT))" for k, n in _QUOTAS.items())
        + ") t(letter, wanted)",
    ),
)
def balance_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per letter of the stratified sample beside the rows wanted."""
    return sampling.balance_report(_stratified(spark, folder), fv.STRATIFIED_LIMIT - 2)


@register(
    "sample_uniform",
    ov.query(
        f"""
        SELECT item_id, question, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM mcq
        ORDER BY {_ORDER} LIMIT 254""",
        "mcq",
    ),
)
def sample_uniform(spark: SparkSession, folder: str) -> DataFrame:
    df = sampling.sample_uniform(fx.mcq(spark, folder), 254, "item_id", _SEED)
    return df.select("item_id", "question", "rank")


@register(
    "sample_training",
    ov.query(
        f"SELECT item_id, correct FROM mcq ORDER BY {_ORDER} LIMIT {fv.STRATIFIED_LIMIT + 1}",
        "mcq",
    ),
)
def sample_training(spark: SparkSession, folder: str) -> DataFrame:
    """One row above the limit of stratified samples: the uniform path."""
    df = sampling.sample_training(
        fx.mcq(spark, folder), fv.STRATIFIED_LIMIT + 1, "item_id", _SEED
    )
    return df.select("item_id", "correct")


@register(
    "seeded_rank",
    ov.query(
        f"SELECT item_id, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM mcq", "mcq"
    ),
)
def seeded_rank(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.seeded_rank(fx.mcq(spark, folder), "item_id", _SEED).select("item_id", "rank")


@register(
    "seeded_rank_responses",
    ov.query(
        f"""
        SELECT response_id, run, row_number() OVER (ORDER BY
               {ov.seeded(_SEED, 'response_id')}, response_id) AS rank
        FROM responses""",
        "responses",
    ),
)
def seeded_rank_responses(spark: SparkSession, folder: str) -> DataFrame:
    df = sampling.seeded_rank(fx.responses(spark, folder), "response_id", _SEED)
    return df.select("response_id", "run", "rank")


_SMALLEST = " ".join(f"WHEN rank <= {n} THEN {n}" for n in fv.NESTED_SIZES)


@register(
    "prefix_sizes",
    ov.query(
        f"""
        SELECT response_id, rank, CAST(CASE {_SMALLEST} END AS BIGINT) AS smallest_n
        FROM ranked WHERE rank <= {fv.NESTED_SIZES[-1]}""",
        "responses",
        ranked=f"""SELECT response_id, row_number() OVER (ORDER BY
                   {ov.seeded(_SEED, 'response_id')}, response_id) AS rank FROM responses""",
    ),
)
def prefix_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of 500 to 5,000 rows, each inside the next."""
    df = sampling.nested_prefixes(
        fx.responses(spark, folder), fv.NESTED_SIZES, "response_id", _SEED
    )
    return df.select("response_id", "rank", "smallest_n")


@register(
    "first_rows",
    ov.query("SELECT item_id, question FROM mcq ORDER BY item_id LIMIT 500", "mcq"),
)
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.first_n(fx.mcq(spark, folder), 500, "item_id").select("item_id", "question")


@register(
    "report_slice",
    ov.query("SELECT item_id, question, correct FROM mcq ORDER BY item_id LIMIT 5 OFFSET 20", "mcq"),
)
def report_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 20 to 24, for a look at single cases."""
    df = sampling.first_n(fx.mcq(spark, folder), 5, "item_id", offset=20)
    return df.select("item_id", "question", "correct")


_SHOTS = 2


def _draw(i: int) -> str:
    return ov.number_of(ov.seeded(_SEED, f"'{i}'", "item_id"))


# Two places, the second moved past the question's own place and the first one.
_PLACED = f"""
    SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS own, count(*) OVER () AS total FROM mcq"""
_FIRST = f"""
    SELECT *, {_draw(0)} % (total - 1)
              + CASE WHEN {_draw(0)} % (total - 1) >= own THEN 1 ELSE 0 END AS place0
    FROM placed"""
_SECOND = f"""
    SELECT *, q + CASE WHEN q >= greatest(own, place0) THEN 1 ELSE 0 END AS place1
    FROM (SELECT *, r + CASE WHEN r >= least(own, place0) THEN 1 ELSE 0 END AS q
          FROM (SELECT *, {_draw(1)} % (total - 2) AS r FROM first))"""
_DRAWS = {"placed": _PLACED, "first": _FIRST, "second": _SECOND}


@register(
    "fewshot_pairs",
    ov.query(
        """
        SELECT s.item_id, 0 AS slot, p.item_id AS ex_id FROM second s JOIN placed p ON p.own = place0
        UNION ALL
        SELECT s.item_id, 1, p.item_id FROM second s JOIN placed p ON p.own = place1""",
        "mcq",
        **_DRAWS,
    ),
)
def fewshot_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Two other items for every item."""
    return fewshot.draw_examples(fx.mcq(spark, folder), _SHOTS, "item_id", _SEED)


_OPEN = """'Instruction: ' || {0}question || ' options: '
    || list_aggregate({0}options, 'string_agg', ', ') || chr(10) || 'Output: '"""
_LETTER = _OPEN + " || 'Answer: ' || {0}correct || chr(10) || chr(10)"
_REASONED = _OPEN + " || {0}rationale || ' Answer: ' || {0}correct || chr(10) || chr(10)"


def _prompt_sql(example: str) -> str:
    return ov.query(
        f"""
        SELECT s.item_id, {example.format('a.')} || {example.format('b.')} || {_OPEN.format('s.')}
               AS few_shot_prompt
        FROM second s JOIN placed a ON a.own = place0 JOIN placed b ON b.own = place1""",
        "mcq",
        **_DRAWS,
    )


@register("fewshot_letter_prompt", _prompt_sql(_LETTER))
def fewshot_letter_prompt(spark: SparkSession, folder: str) -> DataFrame:
    df = fewshot.letter_prompts(fx.mcq(spark, folder), _SHOTS, "item_id", _SEED)
    return df.select("item_id", "few_shot_prompt")


@register("fewshot_rationale_prompt", _prompt_sql(_REASONED))
def fewshot_rationale_prompt(spark: SparkSession, folder: str) -> DataFrame:
    df = fewshot.rationale_prompts(fx.mcq(spark, folder), _SHOTS, "item_id", _SEED)
    return df.select("item_id", "few_shot_prompt")


@register(
    "fewshot_from_other_split",
    ov.query(
        f"""
        SELECT q.item_id, 0 AS slot, p.item_id AS ex_id
        FROM questions q JOIN pool p ON p.place = {_draw(0).replace('item_id', 'q.item_id')} % total""",
        "mcq",
        questions="SELECT item_id FROM mcq WHERE kind = 'economy'",
        pool=f"""SELECT item_id, row_number() OVER (ORDER BY {_ORDER}) - 1 AS place,
                        count(*) OVER () AS total FROM mcq WHERE kind <> 'economy'""",
    ),
)
def fewshot_from_other_split(spark: SparkSession, folder: str) -> DataFrame:
    """Examples for one kind of items, drawn from all the other kinds."""
    items = fx.mcq(spark, folder)
    questions, pool = items.where("kind = 'economy'"), items.where("kind <> 'economy'")
    return fewshot.draw_examples(questions, 1, "item_id", _SEED, pool)
