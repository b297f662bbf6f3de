"""Item, option and prompt queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions import options as opt
from quizlake.functions import prompts
from quizlake.operators import items as prep
from quizlake.plans import fixtures as fx
from quizlake.plans import oracle_views as ov
from quizlake.plans.registry import register

_NL = "chr(10)"


def _q() -> Column:
    return F.col("question")


def _o() -> Column:
    return F.col("options")


@register(
    "items_prepared",
    ov.query(
        """
        SELECT item_id, question, list_aggregate(options, 'string_agg', '|') AS options_text,
               correct, kind, CAST(NULL AS VARCHAR) AS LLMs_rationale,
               CAST(NULL AS VARCHAR) AS LLMs_answer, 'pending' AS status
        FROM mcq""",
        "mcq",
    ),
)
def items_prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Human rationale dropped, empty reply columns added."""
    df = prep.add_answer_columns(prep.drop_rationale(fx.mcq(spark, folder)))
    return df.withColumn("options_text", F.array_join("options", "|")).drop("options")


def _parsed(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    df = prep.parse_options(fx.mcq_raw(spark, folder), mode=mode)
    return df.select(
        "item_id",
        F.when(_o().isNotNull(), F.size(_o())).cast("bigint").alias("n_options"),
        F.array_join("options", "|").alias("options_text"),
    )


@register(
    "options_parsed",
    ov.query(
        """
        SELECT item_id, CAST(len(options) AS BIGINT) AS n_options,
               list_aggregate(options, 'string_agg', '|') AS options_text FROM parsed""",
        "parsed",
    ),
)
def options_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "json")


@register(
    "options_legacy_quoted",
    ov.query(
        """
        SELECT item_id, CAST(len(options) AS BIGINT) AS n_options,
               list_aggregate(options, 'string_agg', '|') AS options_text
        FROM (SELECT item_id, regexp_extract_all(options_json, '"([^"]+)"', 1) AS options
              FROM mcq_raw)""",
        "mcq_raw",
    ),
)
def options_legacy_quoted(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder, "legacy_quoted")


@register(
    "options_round_trip",
    ov.query(
        """
        SELECT item_id, options_text AS by_json, options_text AS by_list
        FROM (SELECT item_id, list_aggregate(options, 'string_agg', '|') AS options_text
              FROM parsed)""",
        "parsed",
    ),
)
def options_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Options out to JSON and list text and back again."""
    df = prep.parse_options(fx.mcq_raw(spark, folder))
    by_json = opt.options_from_json(opt.options_to_json(_o()))
    by_list = opt.options_from_list_text(opt.options_to_list_text(_o()))
    return df.select(
        "item_id",
        F.array_join(by_json, "|").alias("by_json"),
        F.array_join(by_list, "|").alias("by_list"),
    )


def _lettered_sql(separator: str, options: str = "options") -> str:
    pieces = [f"'{letter}{separator}' || {options}[{j}]" for j, letter in enumerate(fv.LETTERS, 1)]
    return "(" + " || ', ' || ".join(pieces) + ")"


_COMMA = "list_aggregate(options, 'string_agg', ', ')"
_SPACED = "list_aggregate(options[1:5], 'string_agg', ' ')"


@register(
    "options_lettered",
    ov.query(
        f"""
        SELECT item_id, {_lettered_sql(": ")} AS spaced, {_lettered_sql(":")} AS tight,
               {_COMMA} AS comma
        FROM mcq""",
        "mcq",
    ),
)
def options_lettered(spark: SparkSession, folder: str) -> DataFrame:
    return fx.mcq(spark, folder).select(
        "item_id",
        opt.lettered(_o(), ": ").alias("spaced"),
        opt.lettered(_o(), ":").alias("tight"),
        opt.comma_joined(_o()).alias("comma"),
    )


@register(
    "correct_text",
    ov.query("SELECT item_id, correct, options[ascii(correct) - 64] AS answer_text FROM parsed", "parsed"),
)
def correct_text(spark: SparkSession, folder: str) -> DataFrame:
    """Option behind the letter; null where options are unreadable or the letter points nowhere."""
    df = prep.add_correct_text(prep.parse_options(fx.mcq_raw(spark, folder)))
    return df.select("item_id", "correct", "answer_text")


_REASON = """
    CASE WHEN options IS NULL THEN 'bad_options' WHEN len(options) <> 5 THEN 'option_count'
         WHEN len(list_filter(options, lambda o: o IS NULL)) > 0 THEN 'null_option'
         WHEN correct NOT IN ('A','B','C','D','E') THEN 'bad_letter' ELSE 'ok' END"""


@register(
    "quarantine_reasons",
    ov.query(f"SELECT {_REASON} AS reason, count(*) AS n FROM parsed GROUP BY 1", "parsed"),
)
def quarantine_reasons(spark: SparkSession, folder: str) -> DataFrame:
    df = prep.add_reason(prep.parse_options(fx.mcq_raw(spark, folder)))
    return df.groupBy("reason").agg(F.count("*").alias("n"))


@register(
    "quarantined_items",
    ov.query(
        f"SELECT * FROM (SELECT item_id, options_json, correct, {_REASON} AS reason FROM parsed)"
        " WHERE reason <> 'ok'",
        "parsed",
    ),
)
def quarantined_items(spark: SparkSession, folder: str) -> DataFrame:
    _, bad = prep.split_usable(prep.parse_options(fx.mcq_raw(spark, folder)))
    return bad.select("item_id", "options_json", "correct", "reason")


def _texts(spark: SparkSession, folder: str, text: Column, source=fx.mcq) -> DataFrame:
    return source(spark, folder).select("item_id", text.alias("text"))


_TRAIN = f"'question: ' || question || ' options: ' || {_SPACED}"
_OPEN = f"'Instruction: ' || question || ' options: ' || {_COMMA} || {_NL} || 'Output: '"
_KEPT = f"""array_to_string(list_filter(string_split(regexp_replace(LLMs_rationale,
    '^{fv.SPACE}+|{fv.SPACE}+$', '', 'g'), {_NL} || {_NL}),
    lambda p: NOT contains(p, '{fv.CLOSING_PHRASE}')), {_NL} || {_NL})"""


@register(
    "prompt_seq2seq_train",
    ov.query(
        f"""SELECT item_id, {_TRAIN} AS text, options[ascii(correct) - 64] AS answer FROM mcq""",
        "mcq",
    ),
)
def prompt_seq2seq_train(spark: SparkSession, folder: str) -> DataFrame:
    return fx.mcq(spark, folder).select(
        "item_id",
        prompts.seq2seq_input(_q(), _o()).alias("text"),
        opt.option_of_letter(_o(), F.col("correct")).alias("answer"),
    )


@register(
    "prompt_seq2seq_eval",
    ov.query(f"SELECT item_id, {_TRAIN} || '.' AS text FROM mcq", "mcq"),
)
def prompt_seq2seq_eval(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, prompts.seq2seq_input(_q(), _o(), final_stop=True))


@register(
    "prompt_seq2seq_kd",
    ov.query(
        f"SELECT item_id, {_TRAIN} || ', ' || {_KEPT} AS text FROM rationales", "rationales"
    ),
)
def prompt_seq2seq_kd(spark: SparkSession, folder: str) -> DataFrame:
    text = prompts.seq2seq_distil_input(_q(), _o(), F.col("LLMs_rationale"))
    return _texts(spark, folder, text, fx.rationales)


@register(
    "prompt_instruct_human",
    ov.query(
        f"""
        SELECT item_id, {_OPEN} || rationale AS text,
               'Instruction: ' || question || ' options: ' || {_COMMA} || '\\Output: ' || rationale
                   AS legacy_text
        FROM mcq""",
        "mcq",
    ),
)
def prompt_instruct_human(spark: SparkSession, folder: str) -> DataFrame:
    options, rationale = opt.comma_joined(_o()), F.col("rationale")
    return fx.mcq(spark, folder).select(
        "item_id",
        prompts.instruct_text(_q(), options, rationale).alias("text"),
        prompts.instruct_text(_q(), options, rationale, mode="legacy").alias("legacy_text"),
    )


@register(
    "prompt_instruct_teacher",
    ov.query(
        f"""
        SELECT item_id, {_OPEN} || LLMs_rationale AS text,
               'Instruction: ' || question || ' options: '
                   || array_to_string(string_split(CAST(to_json(options) AS VARCHAR), ''), ', ')
                   || '\\Output: ' || LLMs_rationale AS legacy_text
        FROM rationales""",
        "rationales",
    ),
)
def prompt_instruct_teacher(spark: SparkSession, folder: str) -> DataFrame:
    """Teacher rationales; the legacy text spreads unparsed options character by character."""
    rationale = F.col("LLMs_rationale")
    spread = opt.comma_spread(opt.options_to_json(_o()))
    return fx.rationales(spark, folder).select(
        "item_id",
        prompts.instruct_text(_q(), opt.comma_joined(_o()), rationale).alias("text"),
        prompts.instruct_text(_q(), spread, rationale, mode="legacy").alias("legacy_text"),
    )


@register("prompt_zero_shot", ov.query(f"SELECT item_id, {_OPEN} AS text FROM mcq", "mcq"))
def prompt_zero_shot(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, prompts.zero_shot(_q(), _o()))


@register(
    "prompt_teacher_mcq",
    ov.query(
        f"SELECT item_id, question || {_NL} || {_NL} || 'Options: ' || {_lettered_sql(': ')}"
        " AS text FROM mcq",
        "mcq",
    ),
)
def prompt_teacher_mcq(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, prompts.teacher_mcq(_q(), _o()))


@register(
    "prompt_teacher_numeric",
    ov.query(
        f"SELECT item_id, {ov.quote(fv.NUMERIC_INSTRUCTION)} || question AS text FROM numeric_items",
        "numeric_items",
    ),
)
def prompt_teacher_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, prompts.teacher_numeric(_q()), fx.numeric_items)


@register(
    "prompt_step_by_step",
    ov.query(
        f"""
        SELECT item_id, 'Question: ' || question || {_NL} || 'Answer choices: '
               || {_lettered_sql(':')} || '.' || {_NL} || {ov.quote(fv.STEP_INSTRUCTION)} AS text
        FROM mcq""",
        "mcq",
    ),
)
def prompt_step_by_step(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, prompts.step_by_step(_q(), _o()))


def _filled_sql(template: str) -> str:
    return (
        f"replace(replace({ov.quote(template)}, '{{prompt}}', question), '{{options_text}}',"
        f" {_lettered_sql(':')})"
    )


@register(
    "prompt_template",
    ov.query(
        f"""
        SELECT item_id, {_filled_sql(fv.TEMPLATE_WITH_CLOSING)} AS with_closing,
               {_filled_sql(fv.TEMPLATE_PLAIN)} AS plain
        FROM mcq""",
        "mcq",
    ),
)
def prompt_template(spark: SparkSession, folder: str) -> DataFrame:
    return fx.mcq(spark, folder).select(
        "item_id",
        prompts.from_template(fv.TEMPLATE_WITH_CLOSING, _q(), _o()).alias("with_closing"),
        prompts.from_template(fv.TEMPLATE_PLAIN, _q(), _o()).alias("plain"),
    )
