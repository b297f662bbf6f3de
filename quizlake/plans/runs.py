"""Source, sink and run-comparison queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions import extract, runnames
from quizlake.functions.options import options_to_list_text
from quizlake.operators import items as prep
from quizlake.operators import leaderboard as board
from quizlake.operators import scoring
from quizlake.operators.joins import attach, missing_runs, pending
from quizlake.operators.rescore import reextract, score_table, write_score_sheet
from quizlake.plans import fixtures as fx
from quizlake.plans import oracle_views as ov
from quizlake.plans.registry import register
from quizlake.session import materialise, scratch_path
from quizlake.sources import database_file, run_csv, tables
from quizlake.sources.result_table import ResultTable
from quizlake.sources.score_log import ScoreLog


@register("column_scan", "SELECT p_partkey, p_type FROM part")
def column_scan(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_table(spark, f"{folder}/part.parquet", ["p_partkey", "p_type"])


@register(
    "split_scan",
    ov.query("SELECT item_id, question, correct FROM mcq WHERE kind = 'economy'", "mcq"),
)
def split_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Items laid out by split, then one split read back."""
    path = scratch_path(spark, "items")
    laid_out = fx.mcq(spark, folder).withColumns(
        {"dataset": F.lit("parts"), "subset": F.lit("sizes"), "split": F.col("kind")}
    )
    tables.write_items(laid_out, path)
    split = tables.read_split(spark, path, "parts", "economy", "sizes")
    return split.select("item_id", "question", "correct")


# One item in 37 has no reference letter.
_REFERENCED = """
    SELECT item_id, question, options, kind, CASE WHEN item_id % 37 <> 0 THEN correct END AS correct FROM mcq"""


def _referenced(items: DataFrame) -> DataFrame:
    return items.withColumn("correct", F.when(F.col("item_id") % 37 != 0, F.col("correct")))


#: Ends a record in files that Spark may split.
_SEPARATOR = "\x1e"


def _written_runs(spark: SparkSession, folder: str, record_separator: str | None = None) -> str:
    path = scratch_path(spark, "runs-csv")
    items = _referenced(fx.mcq(spark, folder)).select("item_id", "question", "options", "correct")
    records = attach(fx.responses(spark, folder), items, "item_id", "left").select(
        "run", "question", "options", "correct", F.col("response").alias("llm_answer")
    )
    run_csv.write_run_csv(records, path, record_separator)
    return path


@register(
    "csv_runs_scored",
    ov.query(
        f"""
        SELECT run, count(*) AS n, count(pred) AS answered,
               count(*) FILTER (WHERE correct IS NULL) AS no_reference,
               round(avg(CASE WHEN pred = correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE correct IS NOT NULL), 6) AS em,
               sum(len(options)) AS options_read
        FROM (SELECT *, {ov.last_letter('response')} AS pred FROM responses)
             LEFT JOIN referenced USING (item_id) GROUP BY run""",
        "mcq",
        "responses",
        referenced=_REFERENCED,
    ),
)
def csv_runs_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Records out to CSV, a folder per run, read back and scored."""
    path = _written_runs(spark, folder, _SEPARATOR)
    rows = run_csv.read_run_csv(spark, path, "*.csv", _SEPARATOR)
    graded = rows.select(
        "run",
        "correct",
        extract.last_letter(F.col("llm_answer")).alias("pred"),
        F.size("options").alias("_options"),
    )
    known, hit = F.col("correct").isNotNull(), F.col("pred").eqNullSafe(F.col("correct"))
    return graded.groupBy("run").agg(
        F.count("*").alias("n"),
        F.count("pred").alias("answered"),
        F.count_if(~known).alias("no_reference"),
        F.round(F.avg(F.when(known, hit.cast("int"))), 6).alias("em"),
        F.sum("_options").cast("bigint").alias("options_read"),
    )


@register(
    "score_sheet_grown",
    ov.query(
        f"""
        SELECT run, count(*) AS n, count(pred) AS answered, count(*) FILTER (WHERE reply IS NULL) AS blank,
               count(*) FILTER (WHERE correct IS NULL) AS no_reference,
               round(avg(CASE WHEN pred = correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE correct IS NOT NULL), 6) AS em
        FROM (SELECT *, {ov.last_letter('reply')} AS pred
              FROM (SELECT *, CASE WHEN run = 'run_o' THEN response || ' Answer: C' ELSE response END AS reply FROM responses))
             LEFT JOIN referenced USING (item_id) GROUP BY run""",
        "mcq",
        "responses",
        referenced=_REFERENCED,
    ),
)
def score_sheet_grown(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet over all runs but one, then over that one too, then after another was written anew."""
    path = scratch_path(spark, "runs-csv")
    items = _referenced(fx.mcq(spark, folder)).select("item_id", "question", "options", "correct")
    records = attach(fx.responses(spark, folder), items, "item_id", "left").select(
        "run", "question", "options", "correct", F.col("response").alias("llm_answer")
    )
    log = ScoreLog(spark, scratch_path(spark, "score-log"), path, pattern="*.csv", record_separator=_SEPARATOR)
    again = records.where("run = 'run_o'").withColumn("llm_answer", F.concat("llm_answer", F.lit(" Answer: C")))
    for part in (records.where("run <> 'run_p'"), records.where("run = 'run_p'"), again):
        run_csv.write_run_csv(part, path, _SEPARATOR)
        log.update()
    return log.sheet()


# Every item as a record of a file that was written badly: a field too few, two too many, or as it should be.
_TORN = """
    SELECT item_id % 3 AS shape, correct FROM referenced"""


def _folder_of_all_kinds(spark: SparkSession, folder: str) -> str:
    """Result files, and beside them a torn one, a score sheet, a header alone and an empty file."""
    path = _written_runs(spark, folder)
    items = _referenced(fx.mcq(spark, folder))
    head = F.lit("question,options,correct,llm_answer\n")
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("question", "text", "correct")]
    torn = items.withColumn("text", options_to_list_text(F.col("options"))).withColumn("correct", F.coalesce("correct", F.lit("")))
    answer = F.concat(F.lit('"Answer: '), F.col("correct"), F.lit('"'))
    shape = F.when(F.col("item_id") % 3 == 0, F.lit("")).when(F.col("item_id") % 3 == 1, F.concat(F.lit(","), answer, F.lit(',more,"a, b"')))
    line = F.concat(head, F.concat_ws(",", *quoted), F.coalesce(shape, F.concat(F.lit(","), answer)))
    torn.select(line.alias("value")).write.text(f"{path}/run=torn")
    sheet = scoring.score_runs(fx.responses(spark, folder), items, by=["run"])
    write_score_sheet(sheet, f"{path}/run=sheet")
    items.limit(0).select("question", F.lit("").alias("options"), "correct", F.lit("").alias("llm_answer")).write.csv(f"{path}/run=none", header=True)
    items.limit(0).select("question").write.text(f"{path}/run=blank")
    return path


@register(
    "csv_file_status",
    ov.query(
        """
        SELECT 'ok' AS status, n + fit AS n, blank, no_reference + fit_unknown AS no_reference, short, long
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE response IS NULL) AS blank, count(*) FILTER (WHERE correct IS NULL) AS no_reference
              FROM responses LEFT JOIN referenced USING (item_id)),
             (SELECT count(*) FILTER (WHERE shape = 2) AS fit, count(*) FILTER (WHERE shape = 2 AND correct IS NULL) AS fit_unknown,
                     count(*) FILTER (WHERE shape = 0) AS short, count(*) FILTER (WHERE shape = 1) AS long FROM torn_items)
        UNION ALL SELECT 'no_rows', 0, NULL, NULL, NULL, NULL
        UNION ALL SELECT 'empty_file', 0, NULL, NULL, NULL, NULL
        UNION ALL SELECT 'bad_columns', NULL, NULL, NULL, NULL, NULL""",
        "mcq",
        "responses",
        referenced=_REFERENCED,
        torn_items=_TORN,
    ),
)
def csv_file_status(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per file status; file names differ from run to run, so files are summed up."""
    files = run_csv.run_file_status(spark, _folder_of_all_kinds(spark, folder), pattern="part-*")
    # A sheet has a header per part file, and how many these are is Spark's choice.
    files = files.withColumn("n", F.when(F.col("status") != "bad_columns", F.col("n")))
    return files.groupBy("status").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n", "blank", "no_reference", "short", "long")]
    )


@register(
    "csv_quarantine",
    ov.query(
        """
        SELECT CASE shape WHEN 0 THEN 'short_record' ELSE 'long_record' END AS fault, count(*) AS n
        FROM torn_items WHERE shape < 2 GROUP BY 1
        UNION ALL SELECT 'foreign_header', count(DISTINCT run) + 1 FROM responses""",
        "mcq",
        "responses",
        referenced=_REFERENCED,
        torn_items=_TORN,
    ),
)
def csv_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Records set aside, by fault; the other files' records are not among them."""
    files = run_csv.RunFiles.scan(spark, _folder_of_all_kinds(spark, folder), "part-*")
    # The sheet's header counts once, however many part files repeat it.
    foreign = F.col("fault") == "foreign_header"
    counts = files.quarantine().groupBy("fault").agg(F.count("*").alias("n"), F.count_distinct(F.when(foreign, F.col("record"))).alias("sheet"))
    return counts.select("fault", F.when(foreign, F.col("sheet")).otherwise(F.col("n")).alias("n"))


@register(
    "runs_rewritten",
    ov.query(
        f"""
        SELECT run, count(*) AS n, count(pred) AS answered, CAST(sum(length(reply)) AS BIGINT) AS characters
        FROM (SELECT run, reply, {ov.last_letter('reply')} AS pred
              FROM (SELECT run, CASE WHEN run = 'run_o' THEN response || ' Answer: C' ELSE response END AS reply FROM responses))
        GROUP BY run""",
        "responses",
    ),
)
def runs_rewritten(spark: SparkSession, folder: str) -> DataFrame:
    """All runs written twice and one of them a third time with other replies: each stands once, as last written."""
    path = scratch_path(spark, "runs")
    replies = fx.responses(spark, folder).select("run", "item_id", "response")
    for _ in range(2):
        tables.write_responses(replies, path)
    again = replies.where("run = 'run_o'").withColumn("response", F.concat("response", F.lit(" Answer: C")))
    tables.write_responses(again, path)
    rows = tables.read_table(spark, path).withColumn("pred", extract.last_letter(F.col("response")))
    return rows.groupBy("run").agg(
        F.count("*").alias("n"), F.count("pred").alias("answered"), F.sum(F.length("response")).cast("bigint").alias("characters")
    )


@register(
    "result_table_resumed",
    ov.query(
        """
        SELECT item_id, CASE WHEN kind = 'economy' THEN 'answered' ELSE 'pending' END AS status,
               CASE WHEN kind = 'economy' THEN correct END AS LLMs_answer
        FROM mcq""",
        "mcq",
    ),
)
def result_table_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """A result table created and seeded twice over, appended to, and compacted."""
    table = ResultTable(spark, scratch_path(spark, "results")).create()
    items = prep.add_answer_columns(prep.drop_rationale(fx.mcq(spark, folder)))
    for _ in range(2):
        table.create().seed(items)
    answered = items.where("kind = 'economy'").withColumns(
        {
            "LLMs_rationale": F.concat(F.lit("Answer: "), "correct"),
            "LLMs_answer": F.col("correct"),
            "status": F.lit("answered"),
        }
    )
    table.append(answered)
    table.compact()
    return table.read().select("item_id", "status", "LLMs_answer")


@register(
    "result_table_rescored",
    ov.query(
        f"""
        SELECT item_id % 5 AS part, count(*) AS n,
               count(pred) AS answered, count(*) FILTER (WHERE correct IS NULL) AS no_reference,
               round(avg(CASE WHEN pred = correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE correct IS NOT NULL), 6) AS em
        FROM (SELECT *, {ov.last_letter('response')} AS pred
              FROM responses JOIN referenced USING (item_id) WHERE response_id % 3 <> 0)
        GROUP BY 1""",
        "mcq",
        "responses",
        referenced=_REFERENCED,
    ),
)
def result_table_rescored(spark: SparkSession, folder: str) -> DataFrame:
    """Stored replies read by another rule, the table replaced, and its score taken from it."""
    table = ResultTable(spark, scratch_path(spark, "rescored")).create()
    items = _referenced(fx.mcq(spark, folder))
    replies = fx.responses(spark, folder).withColumnRenamed("response", "LLMs_rationale")
    rows = attach(replies, items.select("item_id", "question", "options", "correct"), "item_id")
    stored = F.when(F.col("response_id") % 3 == 0, "pending").otherwise("unparsed")
    table.append(rows.withColumns({"LLMs_answer": F.lit(None), "status": stored}))
    reextract(table, extract.last_letter)
    return score_table(table, [(F.col("item_id") % 5).alias("part")])


@register(
    "result_table_interleaved",
    ov.query(
        """
        SELECT item_id, CASE WHEN kind = 'economy' THEN 'A' ELSE upper(correct) || '!' END AS LLMs_answer, count(*) AS n
        FROM mcq GROUP BY ALL""",
        "mcq",
    ),
)
def result_table_interleaved(spark: SparkSession, folder: str) -> DataFrame:
    """One writer appends while another replaces the version from before: neither's rows are lost."""
    root = scratch_path(spark, "interleaved")
    one, two = (ResultTable(spark, root).create() for _ in range(2))
    items = prep.add_answer_columns(prep.drop_rationale(fx.mcq(spark, folder)))
    one.append(items.where("kind <> 'economy'").withColumn("LLMs_answer", F.col("correct")))
    changed = one.read().withColumn("LLMs_answer", F.concat(F.upper("LLMs_answer"), F.lit("!")))
    two.append(items.where("kind = 'economy'").withColumn("LLMs_answer", F.lit("A")))
    one.replace(changed)
    return two.read().groupBy("item_id", "LLMs_answer").agg(F.count("*").alias("n"))


@register(
    "csv_grid_scored",
    ov.query(
        f"""
        SELECT shots, run, count(*) AS n, count(*) FILTER (WHERE correct IS NULL) AS no_reference,
               round(avg(CASE WHEN pred = correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE correct IS NOT NULL), 6) AS em
        FROM (SELECT *, {ov.last_letter_after('response', 'n_shot')} AS pred FROM grid_responses)
             LEFT JOIN referenced USING (item_id)
        GROUP BY shots, run""",
        "mcq",
        "grid_responses",
        referenced=_REFERENCED,
    ),
)
def csv_grid_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Result files in a tree of folders, the shot setting being a folder, read and scored at once."""
    path = scratch_path(spark, "grid-csv")
    items = _referenced(fx.mcq(spark, folder)).select("item_id", "question", "options", "correct")
    records = attach(fx.grid_responses(spark, folder), items, "item_id", "left").select(
        "shots", "run", "question", "options", "correct", F.col("response").alias("llm_answer")
    )
    run_csv.write_run_csv(records, path, record_separator=_SEPARATOR, above=["shots"], few_files=True)
    rows = run_csv.read_run_csv_tree(spark, path, "*.csv", record_separator=_SEPARATOR)
    setting = F.element_at(F.split(F.col("folders")[0], "="), 2)
    run = F.url_decode(F.element_at(F.split(F.col("folders")[1], "="), 2))
    shots = F.when(setting == "zero_shot", 0).otherwise(1)
    graded = rows.select(
        setting.alias("shots"), run.alias("run"), "correct", extract.last_letter_after(F.col("llm_answer"), shots).alias("pred")
    )
    return scoring.score_sheet(graded, ["shots", "run"], "pred", "correct").drop("answered")


@register(
    "database_scan",
    ov.query(
        """
        SELECT kind, count(*) AS n, count(DISTINCT question) AS questions, CAST(sum(item_id) AS BIGINT) AS ids, min(correct) AS least
        FROM mcq WHERE correct >= 'B' GROUP BY kind""",
        "mcq",
    ),
)
def database_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Items written to database files, in two commits, and read back in ranges, by some columns and a condition."""
    path = scratch_path(spark, "items-db")
    items = fx.mcq(spark, folder).select("item_id", "kind", "question", options_to_list_text(F.col("options")).alias("options"), "correct")
    for part in (items.where("kind = 'economy'"), items.where("kind <> 'economy'")):
        database_file.write_database_files(part, path, "items")
    rows = database_file.read_database_file(spark, path, "items", ["item_id", "kind", "question", "correct"]).where("correct >= 'B'")
    return rows.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_distinct("question").alias("questions"), F.sum("item_id").alias("ids"), F.min("correct").alias("least")
    )


@register(
    "pending_rows",
    ov.query(
        f"""
        SELECT item_id, question FROM mcq
        WHERE item_id NOT IN (SELECT item_id FROM responses
                              WHERE {ov.last_letter('response')} IS NOT NULL)""",
        "mcq",
        "responses",
    ),
)
def pending_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Items that no reply has answered."""
    letter = extract.last_letter(F.col("response"))
    answered = fx.responses(spark, folder).where(letter.isNotNull())
    return pending(fx.mcq(spark, folder), answered, "item_id").select("item_id", "question")


#: Buckets of the co-located tables: at scale, as many as tasks that are to share the work.
_BUCKETS = 8


def _colocated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Items and replies dealt to buckets by item."""
    mark = uuid.uuid4().hex
    items, replies = fx.mcq(spark, folder), fx.responses(spark, folder)
    return tuple(
        tables.write_colocated(df, f"quizlake_{name}_{mark}", scratch_path(spark, name), "item_id", _BUCKETS)
        for name, df in (("items", items), ("replies", replies))
    )


@register(
    "em_by_run_colocated",
    ov.query(
        f"""
        SELECT run, count(*) AS n, count(pred) AS answered, count(*) FILTER (WHERE response IS NULL) AS blank,
               count(*) FILTER (WHERE correct IS NULL) AS no_reference,
               round(avg(CASE WHEN correct IS NULL THEN NULL WHEN pred = correct THEN 1.0 ELSE 0.0 END), 6) AS em
        FROM (SELECT *, {ov.last_letter('response')} AS pred FROM responses) LEFT JOIN mcq USING (item_id) GROUP BY run""",
        "mcq",
        "responses",
    ),
)
def em_by_run_colocated(spark: SparkSession, folder: str) -> DataFrame:
    """Scores over tables that lie in buckets by item: replies and items meet where they are."""
    items, replies = _colocated(spark, folder)
    return scoring.score_runs(replies, items, ["run"], broadcast_bytes=0)


@register(
    "pending_rows_colocated",
    ov.query(
        f"""
        SELECT item_id, question FROM mcq
        WHERE item_id NOT IN (SELECT item_id FROM responses WHERE {ov.last_letter('response')} IS NOT NULL)""",
        "mcq",
        "responses",
    ),
)
def pending_rows_colocated(spark: SparkSession, folder: str) -> DataFrame:
    """Items that no reply has answered, from the same buckets."""
    items, replies = _colocated(spark, folder)
    answered = replies.where(extract.last_letter(F.col("response")).isNotNull())
    return pending(items, answered, "item_id").select("item_id", "question")


@register(
    "missing_runs",
    ov.query(
        """
        SELECT DISTINCT run FROM named
        EXCEPT SELECT run FROM named WHERE pred IS NOT NULL""",
        "responses",
        named=f"""SELECT run || '_' || item_id AS run, {ov.last_letter('response')} AS pred
                  FROM responses""",
    ),
)
def missing_run_names(spark: SparkSession, folder: str) -> DataFrame:
    """Runs, one per status and customer, without a single answered reply."""
    named = fx.responses(spark, folder).select(
        F.concat("run", F.lit("_"), "item_id").alias("run"),
        extract.last_letter(F.col("response")).alias("pred"),
    )
    return missing_runs(named, named.where(F.col("pred").isNotNull()))


_CAUSAL = (
    r"'^(.+?)-finetuned-(.+?)((?:-AM|-teacher)*)-(\d+(?:\.\d+)?)k(?:-r-(\d+))?(?:-alpha-(\d+))?$'"
)
_SMALL = r"'^(kd_)?(lora|full)_finetune_(.+)_([A-Za-z]+)(\d+)$'"


def _group(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(stem, {pattern}, {group}), '')"


_FIELDS = f"""
    CASE WHEN small THEN {_group(_SMALL, 1)} IS NOT NULL
         WHEN causal THEN coalesce(contains({_group(_CAUSAL, 3)}, '-teacher'), false) END AS kd,
    CASE WHEN small THEN {_group(_SMALL, 2)} WHEN causal THEN 'lora' END AS method,
    CASE WHEN small THEN {_group(_SMALL, 3)} ELSE {_group(_CAUSAL, 1)} END AS base_model,
    CASE WHEN small THEN {_group(_SMALL, 4)} ELSE {_group(_CAUSAL, 2)} END AS dataset,
    CASE WHEN small THEN CAST({_group(_SMALL, 5)} AS BIGINT)
         ELSE CAST(round(CAST({_group(_CAUSAL, 4)} AS DOUBLE) * 1000) AS BIGINT) END AS n_train,
    CASE WHEN causal AND contains({_group(_CAUSAL, 3)}, '-AM') THEN 'attention'
         WHEN causal THEN 'all' END AS layers,
    CAST({_group(_CAUSAL, 5)} AS BIGINT) AS r,
    CAST({_group(_CAUSAL, 6)} AS BIGINT) AS alpha"""

_NAMED = f"""
    SELECT *, {_FIELDS}
    FROM (SELECT *, regexp_matches(stem, {_SMALL}) AS small, regexp_matches(stem, {_CAUSAL}) AS causal
          FROM (SELECT *, string_split(run, '/')[-1] AS stem FROM counts))"""

_COUNTS = f"""
    SELECT run, shots, count(*) AS n, count(*) FILTER (WHERE correct IS NULL) AS no_reference,
           sum(CASE WHEN pred = correct THEN 1 ELSE 0 END) AS hits
    FROM (SELECT *, {ov.last_letter_after('response', 'n_shot')} AS pred FROM grid_responses)
         LEFT JOIN referenced USING (item_id) GROUP BY run, shots"""


def _grid_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and hits per named run and shot setting, with the parameters from the names."""
    counts = scoring.run_counts(
        fx.grid_responses(spark, folder), _referenced(fx.mcq(spark, folder)), ["run", "shots"], shots="n_shot"
    )
    return board.with_run_fields(counts)


@register(
    "run_name_fields",
    ov.query(
        """
        SELECT run, CAST(kd AS VARCHAR) AS kd, method, base_model, dataset, n_train, layers, r,
               alpha, n
        FROM named""",
        "grid_responses",
        counts="SELECT run, count(*) AS n FROM grid_responses GROUP BY run",
        named=_NAMED,
    ),
)
def run_name_fields(spark: SparkSession, folder: str) -> DataFrame:
    names = fx.grid_responses(spark, folder).groupBy("run").agg(F.count("*").alias("n"))
    return board.with_run_fields(names).withColumn("kd", F.col("kd").cast("string"))


@register(
    "runs_of_teacher_read",
    ov.query(
        f"""
        SELECT run, method, n_train, count(*) AS n, count(pred) AS answered
        FROM (SELECT *, {ov.last_letter_after('response', 'n_shot')} AS pred FROM grid_responses)
             JOIN (SELECT run, method, n_train FROM named WHERE kd AND n_train >= 1000) USING (run)
        GROUP BY ALL""",
        "grid_responses",
        counts="SELECT run, count(*) AS n FROM grid_responses GROUP BY run",
        named=_NAMED,
    ),
)
def runs_of_teacher_read(spark: SparkSession, folder: str) -> DataFrame:
    """Replies laid out by run, of which only those runs are read whose names say teacher and a thousand examples or more."""
    path = scratch_path(spark, "grid")
    replies = fx.grid_responses(spark, folder)
    tables.write_responses(replies.hint("rebalance", "run"), path)
    names = materialise(board.with_run_fields(replies.select("run").distinct()).select("run", "kd", "method", "n_train"), "run-names")
    rows = tables.read_runs(spark, path, names.where("kd and n_train >= 1000"))
    graded = rows.withColumn("pred", extract.last_letter_after(F.col("response"), F.col("n_shot")))
    return graded.groupBy("run", "method", "n_train").agg(F.count("*").alias("n"), F.count("pred").alias("answered"))


@register(
    "run_names_rebuilt",
    ov.query(
        "SELECT string_split(run, '/')[-1] AS name, count(*) AS n FROM grid_responses GROUP BY 1",
        "grid_responses",
    ),
)
def run_names_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Run names built again from the parameters read out of them."""
    names = fx.grid_responses(spark, folder).groupBy("run").agg(F.count("*").alias("n"))
    fields = board.with_run_fields(names)
    kd, method, model, dataset, n_train = (
        F.col(name) for name in ("kd", "method", "base_model", "dataset", "n_train")
    )
    small = runnames.seq2seq_run_name(kd, method, model, dataset, n_train)
    causal = runnames.causal_run_name(
        model, dataset, F.col("layers") == "attention", kd, n_train, F.col("r"), F.col("alpha")
    )
    name = F.when(F.col("layers").isNull(), small).otherwise(causal)
    return fields.select(name.alias("name"), "n")


@register(
    "leaderboard_rollup",
    ov.query(
        """
        SELECT CAST(kd AS VARCHAR) AS kd, method, shots, n_train,
               4 - CAST(grouping(kd) + grouping(method) + grouping(shots) + grouping(n_train)
                        AS BIGINT) AS level,
               CAST(sum(n) AS BIGINT) AS n, CAST(sum(no_reference) AS BIGINT) AS no_reference,
               round(sum(hits) / nullif(sum(n) - sum(no_reference), 0)::DOUBLE, 6) AS em
        FROM named GROUP BY ROLLUP (kd, method, shots, n_train)""",
        "mcq",
        "grid_responses",
        referenced=_REFERENCED,
        counts=_COUNTS,
        named=_NAMED,
    ),
)
def leaderboard_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = board.leaderboard(
        _grid_counts(spark, folder), ["kd", "method", "shots", "n_train"]
    )
    return rows.withColumn("kd", F.col("kd").cast("string"))


_SHOTS = ["zero_shot", "one_shot", "one_shot_cot", "two_shot"]


def _pivot_sql(shots: str) -> str:
    return (
        f"round(sum(hits) FILTER (WHERE shots = '{shots}')"
        f" / nullif(sum(n - no_reference) FILTER (WHERE shots = '{shots}'), 0)::DOUBLE, 6) AS {shots}"
    )


@register(
    "leaderboard_pivot",
    ov.query(
        f"""
        SELECT base_model, CAST(kd AS VARCHAR) AS kd, layers, n_train, r, alpha,
               {", ".join(_pivot_sql(shots) for shots in _SHOTS)}
        FROM named GROUP BY ALL""",
        "mcq",
        "grid_responses",
        referenced=_REFERENCED,
        counts=_COUNTS,
        named=_NAMED,
    ),
)
def leaderboard_pivot(spark: SparkSession, folder: str) -> DataFrame:
    dimensions = ["base_model", "kd", "layers", "n_train", "r", "alpha"]
    rows = board.by_shots(_grid_counts(spark, folder), dimensions, _SHOTS)
    return rows.withColumn("kd", F.col("kd").cast("string"))
