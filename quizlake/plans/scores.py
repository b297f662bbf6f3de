"""Extraction and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions import compare, extract
from quizlake.functions.options import option_of_letter
from quizlake.operators import scoring
from quizlake.plans import fixtures as fx
from quizlake.plans import oracle_views as ov
from quizlake.plans.registry import register

_LAST = ov.last_letter("response")


@register(
    "em_by_run",
    ov.query(
        """
        SELECT run, count(*) AS n, count(pred) AS answered,
               count(*) FILTER (WHERE response IS NULL) AS blank,
               count(*) FILTER (WHERE correct IS NULL) AS no_reference,
               round(avg(CASE WHEN correct IS NULL THEN NULL
                              WHEN pred = correct THEN 1.0 ELSE 0.0 END), 6) AS em
        FROM graded LEFT JOIN mcq USING (item_id) GROUP BY run""",
        "mcq",
        "responses",
        graded=f"SELECT *, {_LAST} AS pred FROM responses",
    ),
)
def em_by_run(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_runs(fx.responses(spark, folder), fx.mcq(spark, folder), ["run"])


@register(
    "em_by_run_few_shot",
    ov.query(
        """
        SELECT run, shots, count(*) AS n, count(pred) AS answered,
               count(*) FILTER (WHERE response IS NULL) AS blank,
               count(*) FILTER (WHERE correct IS NULL) AS no_reference,
               round(avg(CASE WHEN correct IS NULL THEN NULL
                              WHEN pred = correct THEN 1.0 ELSE 0.0 END), 6) AS em
        FROM graded LEFT JOIN mcq USING (item_id) GROUP BY run, shots""",
        "mcq",
        "few_shot_responses",
        graded=f"SELECT *, {ov.last_letter_after('response', 'shots')} AS pred FROM few_shot_responses",
    ),
)
def em_by_run_few_shot(spark: SparkSession, folder: str) -> DataFrame:
    replies = fx.few_shot_responses(spark, folder)
    return scoring.score_runs(replies, fx.mcq(spark, folder), ["run", "shots"], shots="shots")


@register(
    "letter_last",
    ov.query(f"SELECT response_id, {_LAST} AS letter FROM responses", "responses"),
)
def letter_last(spark: SparkSession, folder: str) -> DataFrame:
    letter = extract.last_letter(F.col("response"))
    return fx.responses(spark, folder).select("response_id", letter.alias("letter"))


@register(
    "letter_nshot",
    ov.query(
        f"SELECT response_id, shots, {ov.last_letter_after('response', 'shots')} AS letter"
        " FROM few_shot_responses",
        "few_shot_responses",
    ),
)
def letter_nshot(spark: SparkSession, folder: str) -> DataFrame:
    letter = extract.last_letter_after(F.col("response"), F.col("shots"))
    return fx.few_shot_responses(spark, folder).select(
        "response_id", "shots", letter.alias("letter")
    )


@register(
    "letter_clean",
    ov.query(f"SELECT response_id, {ov.clean_letter('response')} AS letter FROM responses", "responses"),
)
def letter_clean(spark: SparkSession, folder: str) -> DataFrame:
    letter = extract.clean_letter(F.col("response"))
    return fx.responses(spark, folder).select("response_id", letter.alias("letter"))


@register(
    "letter_after_phrase",
    ov.query(
        f"SELECT response_id, {ov.letter_after_phrase('response')} AS letter FROM responses",
        "responses",
    ),
)
def letter_after_phrase(spark: SparkSession, folder: str) -> DataFrame:
    letter = extract.letter_after_phrase(F.col("response"))
    return fx.responses(spark, folder).select("response_id", letter.alias("letter"))


@register(
    "letter_strict",
    ov.query(
        f"SELECT response_id, {ov.strict_letter('response')} AS letter FROM strict_responses",
        "strict_responses",
    ),
)
def letter_strict(spark: SparkSession, folder: str) -> DataFrame:
    letter = extract.strict_letter(F.col("response"))
    return fx.strict_responses(spark, folder).select("response_id", letter.alias("letter"))


@register(
    "numeric_last_text",
    ov.query(
        f"SELECT response_id, {ov.last_number_text('response')} AS number FROM numeric_responses",
        "numeric_responses",
    ),
)
def numeric_last_text(spark: SparkSession, folder: str) -> DataFrame:
    number = extract.last_number_text(F.col("response"))
    return fx.numeric_responses(spark, folder).select("response_id", number.alias("number"))


@register(
    "numeric_last_double",
    ov.query(
        f"SELECT response_id, try_cast({ov.last_number_text('response')} AS DOUBLE) AS number"
        " FROM numeric_responses",
        "numeric_responses",
    ),
)
def numeric_last_double(spark: SparkSession, folder: str) -> DataFrame:
    number = extract.last_number(F.col("response"))
    return fx.numeric_responses(spark, folder).select("response_id", number.alias("number"))


@register(
    "numeric_in_documents",
    ov.query(f"SELECT doc_id, {ov.last_number_text('text')} AS number FROM documents"),
)
def numeric_in_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The number rule over the whole of every free text."""
    number = extract.last_number_text(F.col("text"))
    return fx.documents(spark, folder).select("doc_id", number.alias("number"))


@register(
    "letter_in_conversations",
    ov.query(
        f"SELECT conv_id, turn, {ov.last_letter('text')} AS last_letter,"
        f" {ov.clean_letter('text')} AS clean_letter FROM talk",
        "talk",
    ),
)
def letter_in_conversations(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    return fx.talk(spark, folder).select(
        "conv_id",
        "turn",
        extract.last_letter(text).alias("last_letter"),
        extract.clean_letter(text).alias("clean_letter"),
    )


def _graded(replies: DataFrame, items: DataFrame, rule) -> DataFrame:
    """(run, pred, correct, _n): answers beside their references."""
    answers = replies.select("run", "item_id", rule(F.col("response")).alias("pred"))
    return scoring.with_reference(answers, items, ["correct"])


_SHEET = """
    SELECT run, count(*) AS n, count(pred) AS answered,
           count(*) FILTER (WHERE NOT known) AS no_reference,
           round(avg(CASE WHEN known THEN hit END), 6) AS em
    FROM scored GROUP BY run"""


def _sheet(rule: str, known: str, hit: str) -> str:
    return ov.query(
        _SHEET,
        "mcq",
        "responses",
        graded=f"SELECT *, {rule} AS pred FROM responses LEFT JOIN mcq USING (item_id)",
        scored=f"SELECT run, pred, {known} AS known, CASE WHEN {hit} THEN 1.0 ELSE 0.0 END AS hit"
        " FROM graded",
    )


@register(
    "em_normalised",
    _sheet(
        ov.clean_letter("response"),
        "correct IS NOT NULL",
        f"{ov.normalised('pred')} = {ov.normalised('correct')}",
    ),
)
def em_normalised(spark: SparkSession, folder: str) -> DataFrame:
    rows = _graded(fx.responses(spark, folder), fx.mcq(spark, folder), extract.clean_letter)
    return scoring.score_sheet(rows, ["run"], "pred", "correct", normalise=True, weight="_n")


@register(
    "em_legacy",
    _sheet(
        ov.letter_after_phrase("response"),
        "true",
        ov.normalised("coalesce(pred, '')") + " = " + ov.normalised("coalesce(correct, '')"),
    ),
)
def em_legacy(spark: SparkSession, folder: str) -> DataFrame:
    rows = _graded(fx.responses(spark, folder), fx.mcq(spark, folder), extract.letter_after_phrase)
    return scoring.score_sheet(
        rows, ["run"], "pred", "correct", mode="legacy", normalise=True, weight="_n"
    )


@register(
    "em_nullsafe",
    _sheet(_LAST, "true", "pred IS NOT DISTINCT FROM nullif(correct, 'E')"),
)
def em_nullsafe(spark: SparkSession, folder: str) -> DataFrame:
    """Two missing values count as equal; letter E stands in for a missing reference."""
    rows = _graded(fx.responses(spark, folder), fx.mcq(spark, folder), extract.last_letter)
    rows = rows.withColumn("correct", F.nullif("correct", F.lit("E")))
    return scoring.score_sheet(rows, ["run"], "pred", "correct", mode="nullsafe", weight="_n")


@register(
    "em_raw",
    ov.query(
        """
        SELECT run, n, answered, no_reference, em, round(em, 4) AS fraction,
               round(em * 100, 2) AS percent
        FROM (SELECT run, count(*) AS n, count(*) FILTER (WHERE pred <> 'N/A') AS answered,
                     count(*) FILTER (WHERE correct IS NULL) AS no_reference,
                     round(avg(CASE WHEN correct IS NULL THEN NULL
                                    WHEN pred = upper(correct) THEN 1.0 ELSE 0.0 END), 6) AS em
              FROM graded GROUP BY run)""",
        "mcq",
        "strict_responses",
        graded=f"SELECT *, {ov.strict_letter('response')} AS pred"
        " FROM strict_responses LEFT JOIN mcq USING (item_id)",
    ),
)
def em_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Exact match without normalising, as a fraction and as a percentage."""
    items = fx.mcq(spark, folder).withColumn("correct", F.upper("correct"))
    rows = _graded(fx.strict_responses(spark, folder), items, extract.strict_letter)
    sheet = scoring.score_sheet(rows, ["run"], "pred", "correct", weight="_n")
    em = F.col("em")
    return sheet.withColumns(
        {"fraction": compare.as_fraction(em), "percent": compare.as_percent(em)}
    )


@register(
    "em_numeric",
    ov.query(
        f"""
        SELECT run, count(*) AS n, count(pred) AS answered,
               count(*) FILTER (WHERE ref IS NULL) AS no_reference,
               round(avg(CASE WHEN ref IS NULL THEN NULL
                              WHEN {ov.normalised("coalesce(pred, '')")} = {ov.normalised("ref")}
                              THEN 1.0 ELSE 0.0 END), 6) AS em,
               round(avg(CASE WHEN ref IS NULL THEN NULL
                              WHEN try_cast(pred AS DOUBLE) = try_cast(ref AS DOUBLE)
                              THEN 1.0 ELSE 0.0 END), 6) AS em_strict
        FROM graded GROUP BY run""",
        "numeric_responses",
        graded=f"SELECT run, {ov.last_number_text('response')} AS pred,"
        f" coalesce({ov.last_number_text('answer')}, 'None') AS ref FROM numeric_responses",
    ),
)
def em_numeric(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.numeric_responses(spark, folder)
    return scoring.score_numeric(rows, ["run"], "response", "answer")


@register(
    "row_verdicts",
    ov.query(
        f"""
        SELECT response_id, item_id, run, pred, correct,
               CASE WHEN upper(pred) IS NOT DISTINCT FROM upper(correct)
                    THEN 'Correct' ELSE 'Incorrect' END AS verdict
        FROM (SELECT *, {ov.strict_letter('response')} AS pred FROM strict_responses)
             LEFT JOIN mcq USING (item_id)""",
        "mcq",
        "strict_responses",
    ),
)
def row_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.row_verdicts(
        fx.strict_responses(spark, folder), fx.mcq(spark, folder), extract.strict_letter
    )
    return rows.select("response_id", "item_id", "run", "pred", "correct", "verdict")


@register(
    "valid_counts",
    ov.query(
        """
        SELECT run, count(*) AS n,
               count(*) FILTER (WHERE answer IS NOT NULL AND answer <> 'N/A') AS valid,
               count(*) FILTER (WHERE answer IS NULL) AS pending
        FROM (SELECT run, CASE WHEN response IS NOT NULL THEN coalesce(pred, 'N/A') END AS answer
              FROM graded) GROUP BY run""",
        "responses",
        graded=f"SELECT *, {ov.letter_after_phrase('response')} AS pred FROM responses",
    ),
)
def valid_counts(spark: SparkSession, folder: str) -> DataFrame:
    letter = F.coalesce(extract.letter_after_phrase(F.col("response")), F.lit("N/A"))
    answer = F.when(F.col("response").isNotNull(), letter)
    rows = fx.responses(spark, folder).select("run", answer.alias("answer"))
    return scoring.valid_counts(rows, ["run"], "answer")


@register(
    "answer_status",
    ov.query(
        """
        SELECT run, CASE WHEN response IS NULL THEN 'pending' WHEN pred IS NULL THEN 'unparsed'
                         ELSE 'answered' END AS status, count(*) AS n
        FROM graded GROUP BY ALL""",
        "responses",
        graded=f"SELECT *, {_LAST} AS pred FROM responses",
    ),
)
def answer_status(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("response")
    status = compare.answer_status(text, extract.last_letter(text))
    rows = fx.responses(spark, folder).select("run", status.alias("status"))
    return rows.groupBy("run", "status").agg(F.count("*").alias("n"))


_PREDICTED = """
    SELECT run, CASE WHEN silent THEN '' ELSE options[choice + 1] END AS pred,
           options[ascii(correct) - 64] AS answer
    FROM predictions LEFT JOIN mcq USING (item_id)"""


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted option text beside the right one."""
    rows = scoring.with_reference(
        fx.predictions(spark, folder), fx.mcq(spark, folder), ["options", "correct"]
    )
    options = F.col("options")
    pred = F.when(F.col("silent"), "").otherwise(F.get(options, F.col("choice").cast("int")))
    return rows.select(
        "run",
        pred.alias("pred"),
        option_of_letter(options, F.col("correct")).alias("answer"),
        "_n",
    )


@register(
    "text_accuracy",
    ov.query(
        """
        SELECT run, count(*) AS n,
               round(avg(CASE WHEN pred = answer THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM predicted GROUP BY run""",
        "mcq",
        "predictions",
        predicted=_PREDICTED,
    ),
)
def text_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = _predicted(spark, folder)
    return scoring.text_accuracy(rows, ["run"], "pred", "answer", weight="_n")


@register(
    "first_letter_freq",
    ov.query(
        """
        SELECT substr(pred, 1, 1) AS letter, count(*) AS n
        FROM predicted WHERE length(pred) > 0 GROUP BY 1""",
        "mcq",
        "predictions",
        predicted=_PREDICTED,
    ),
)
def first_letter_freq(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.first_letters(_predicted(spark, folder), "pred", weight="_n")
