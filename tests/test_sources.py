import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizlake import schema
from quizlake.functions import extract
from quizlake.operators import items as prep
from quizlake.operators import scoring
from quizlake.sources import run_csv, score_log, tables
from quizlake.sources.commit_log import CommitLog
from quizlake.sources.score_log import ScoreLog
from quizlake.sources.result_table import ResultTable, VersionConflict, create_catalog_table

OPTIONS = ["A)it's", 'B)"2"', "C)3", "D)4\n", "E)5"]


@pytest.fixture()
def run_folder(tmp_path):
    """Files as a data-frame library writes them, with all that can be wrong with them."""
    good = pd.DataFrame(
        {
            "question": ["Q1", 'Q "2"\nsecond line', "Q3", "Q4"],
            "options": [str(OPTIONS)] * 4,
            "correct": ["A", "B", "C", "D"],
            "llm_answer": ["Answer: A", 'It said "hm".\n\nAnswer: B', None, "Answer: A, or"],
        }
    )
    good.to_csv(tmp_path / "base_test.csv", index=False)
    shown = good.assign(
        llm_answer="Answer: E\n\n" + good["llm_answer"].fillna(""), few_shot_prompt="Answer: E\n\n"
    )
    shown.to_csv(tmp_path / "shown_test.csv", index=False)
    good.head(0).to_csv(tmp_path / "header_test.csv", index=False)
    (tmp_path / "empty_test.csv").write_text("")
    pd.DataFrame({"Model Name": ["base"], "EM Score": [0.5]}).to_csv(tmp_path / "em_scores.csv", index=False)
    (tmp_path / "notes.txt").write_text("not a result")
    return str(tmp_path)


def test_every_file_gets_a_row(spark, run_folder):
    rows = {r["file"]: r for r in run_csv.run_file_status(spark, run_folder).collect()}
    assert {name: row["status"] for name, row in rows.items()} == {
        "base_test.csv": "ok",
        "shown_test.csv": "ok",
        "header_test.csv": "no_rows",
        "empty_test.csv": "empty_file",
        "em_scores.csv": "bad_columns",
    }
    base = rows["base_test.csv"]
    assert (base["n"], base["blank"], base["em"]) == (4, 1, 0.5)
    assert rows["empty_test.csv"]["em"] is None and rows["em_scores.csv"]["em"] is None


def test_odd_file_names(spark, run_folder):
    os.rename(f"{run_folder}/base_test.csv", f"{run_folder}/a b+c%_test.csv")
    rows = {r["file"]: r for r in run_csv.run_file_status(spark, run_folder).collect()}
    assert rows["a b+c%_test.csv"]["n"] == 4
    runs = {r["run"] for r in run_csv.read_run_csv(spark, run_folder).collect()}
    assert runs == {"a b+c%_test", "shown_test"}


def test_examples_are_ignored_per_file(spark, run_folder):
    status = run_csv.run_file_status(spark, run_folder, n_shot=1, pattern="shown*.csv")
    assert [r["em"] for r in status.collect()] == [0.5]


def test_runs_are_read_whole(spark, run_folder):
    df = run_csv.read_run_csv(spark, run_folder)
    assert {r["run"]: r["count"] for r in df.groupBy("run").count().collect()} == {"base_test": 4, "shown_test": 4}
    rows = df.where("run = 'base_test'").orderBy("correct").collect()
    assert rows[1]["question"] == 'Q "2"\nsecond line'
    assert rows[1]["llm_answer"] == 'It said "hm".\n\nAnswer: B'
    assert all(row["options"] == OPTIONS for row in rows)
    assert rows[2]["llm_answer"] is None


@pytest.mark.parametrize("separator", [None, "\x1e"])
def test_written_runs_come_back(spark, tmp_path, separator):
    rows = [
        ("a", "Q\n1", OPTIONS, "A", "x\n\nAnswer: A"),
        ("a", 'say "so"', OPTIONS, "B", None),
        ("b", "Q3,", OPTIONS, "C", "back\\slash, Answer: C"),
    ]
    df = spark.createDataFrame(
        rows, "run string, question string, options array<string>, correct string, llm_answer string"
    )
    path = str(tmp_path / "csv")
    run_csv.write_run_csv(df, path, separator)
    back = run_csv.read_run_csv(spark, path, "*.csv", separator)
    got = back.select(*df.columns).orderBy("correct").collect()
    assert [tuple(r) for r in got] == rows
    graded = back.withColumn("pred", extract.last_letter(F.col("llm_answer")))
    scores = {r["run"]: r["em"] for r in scoring.score_sheet(graded, ["run"], "pred", "correct").collect()}
    assert scores == {"a": 0.5, "b": 1.0}


def answered(items, *keys):
    return items.where(F.col("item_id").isin(*keys)).withColumns(
        {"LLMs_rationale": F.lit("Answer: A"), "LLMs_answer": F.lit("A"), "status": F.lit("answered")}
    )


@pytest.fixture()
def ready(items):
    return prep.add_answer_columns(prep.drop_rationale(items)).where("item_id < 20")


def test_table_is_created_once_and_seeded_once(spark, tmp_path, ready):
    table = ResultTable(spark, str(tmp_path / "t"))
    assert table.version() is None
    with pytest.raises(ValueError):
        table.read()
    table.create()
    assert table.read().count() == 0 and table.read().schema == schema.results_schema("mcq")
    table.seed(ready.where("item_id < 5"))
    table.create().seed(ready)
    table.seed(ready)
    assert sorted(r["item_id"] for r in table.read().collect()) == list(range(20))


def test_table_can_be_replaced_by_what_it_holds(spark, tmp_path, ready):
    table = ResultTable(spark, str(tmp_path / "t")).create()
    table.append(ready)
    old = table.read()
    table.replace(old.withColumn("LLMs_answer", F.lit("B")))
    assert {r["LLMs_answer"] for r in table.read().collect()} == {"B"}
    # The plan made before still reads what it was made for.
    assert {r["LLMs_answer"] for r in old.collect()} == {None}


def test_compacting_drops_pending_rows_since_answered(spark, tmp_path, ready):
    table = ResultTable(spark, str(tmp_path / "t")).create()
    table.seed(ready)
    table.append(answered(ready, 3, 4))
    assert table.read().count() == 22
    table.compact()
    rows = {r["item_id"]: r["status"] for r in table.read().collect()}
    assert len(rows) == 20 == table.read().count()
    assert [k for k, status in rows.items() if status == "answered"] in ([3, 4], [4, 3])


def test_a_write_that_was_never_committed_is_not_read(spark, tmp_path, ready):
    table = ResultTable(spark, str(tmp_path / "t")).create()
    table.append(ready)
    # A crash between the write and the commit.
    table._written(ready.limit(1))
    assert table.read().count() == 20
    table.replace(answered(ready, 1))
    assert [r["item_id"] for r in table.read().collect()] == [1]
    assert table.history() == [(1, "create"), (2, "append"), (3, "replace")]
    assert table.read(2).count() == 20


def test_rows_appended_during_a_replacement_are_kept(spark, tmp_path, ready):
    one, two = (ResultTable(spark, str(tmp_path / "t")).create() for _ in range(2))
    one.append(ready.where("item_id < 5"))
    changed = one.read().withColumn("LLMs_answer", F.lit("B"))
    two.append(answered(ready, 7, 8))
    one.replace(changed)
    two.append(answered(ready, 9))
    got = {r["item_id"]: r["LLMs_answer"] for r in one.read().collect()}
    assert got == {**{i: "B" for i in range(5)}, 7: "A", 8: "A", 9: "A"} and one.read().count() == 8


def test_the_later_of_two_replacements_fails_and_is_worked_out_again(spark, tmp_path, ready):
    one, two = (ResultTable(spark, str(tmp_path / "t")).create() for _ in range(2))
    one.append(ready.where("item_id < 3").withColumn("LLMs_answer", F.lit("A")))
    first, second = (t.read().withColumn("LLMs_answer", F.concat("LLMs_answer", F.lit(x))) for t, x in ((one, "1"), (two, "2")))
    one.replace(first)
    with pytest.raises(VersionConflict):
        two.replace(second)
    assert {r["LLMs_answer"] for r in two.read().collect()} == {"A1"}
    calls = []

    def change(rows):
        if not calls:
            one.update(lambda r: r.withColumn("LLMs_answer", F.concat("LLMs_answer", F.lit("x"))))
        calls.append(1)
        return rows.withColumn("LLMs_answer", F.concat("LLMs_answer", F.lit("2")))

    two.update(change)
    assert len(calls) == 2 and {r["LLMs_answer"] for r in one.read().collect()} == {"A1x2"}


def test_two_seeds_at_once_add_each_item_once(spark, tmp_path, ready, monkeypatch):
    one, two = (ResultTable(spark, str(tmp_path / "t")).create() for _ in range(2))
    write = ResultTable._written

    def later(self, df):
        if self is one:
            monkeypatch.setattr(ResultTable, "_written", write)
            two.seed(ready)
        return write(self, df)

    monkeypatch.setattr(ResultTable, "_written", later)
    one.seed(ready)
    assert sorted(r["item_id"] for r in one.read().collect()) == list(range(20))


def test_of_two_commits_to_one_number_one_succeeds(spark, tmp_path):
    one, two = (CommitLog(spark, str(tmp_path / "log")) for _ in range(2))
    assert one.latest() is None
    assert one.put(1, {"by": 1}) and not two.put(1, {"by": 2}) and two.put(2, {"by": 2}) and not one.put(2, {"by": 1})
    assert one.latest() == two.latest() == 2 and one.read(1) == {"by": 1} and one.read(2) == {"by": 2}


def test_numeric_table(spark, tmp_path):
    table = ResultTable(spark, str(tmp_path / "n"), "numeric").create()
    assert table.read().columns == ["item_id", "question", "answer", "LLMs_rationale", "LLMs_answer", "status", "error", "attempts"]
    with pytest.raises(ValueError):
        ResultTable(spark, str(tmp_path / "n"), "other")


def test_catalog_table(spark):
    for kind in ("mcq", "numeric"):
        name = f"results_{kind}_{os.getpid()}"
        try:
            for _ in range(2):
                create_catalog_table(spark, name, kind)
            assert spark.table(name).schema == schema.results_schema(kind)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_one_split_reads_one_folder(spark, tmp_path, items):
    path = str(tmp_path / "items")
    laid_out = items.withColumns({"dataset": F.lit("d"), "subset": F.lit("s"), "split": F.col("kind")})
    tables.write_items(laid_out, path)
    split = tables.read_split(spark, path, "d", "economy")
    assert split.count() == items.where("kind = 'economy'").count()
    assert all("split=economy" in name for name in split.inputFiles()) or "PartitionFilters: [" in (
        split._jdf.queryExecution().executedPlan().toString()
    )
    assert tables.read_split(spark, path, "d", "economy", "other").count() == 0


def test_columns_are_pruned(spark, folder):
    df = tables.read_table(spark, f"{folder}/part.parquet", ["p_partkey"])
    assert "ReadSchema: struct<p_partkey:bigint>" in df._jdf.queryExecution().executedPlan().toString()


def test_responses_by_run(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "run string, item_id long")
    path = str(tmp_path / "r")
    for _ in range(2):
        tables.write_responses(df, path)
    tables.write_responses(df.where("run = 'a'").withColumn("item_id", F.lit(7).cast("long")), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("run", "item_id").collect()) == [("a", 7), ("b", 2)]
    tables.write_responses(df, path, mode="append")
    assert spark.read.parquet(path).where("run = 'a'").count() == 2
    with pytest.raises(ValueError):
        tables.write_responses(df, path, mode="overwrite")


@pytest.mark.parametrize("separator", [None, "\x1e"])
def test_a_run_written_again_replaces_its_files(spark, tmp_path, separator):
    rows = [("a", "q1", OPTIONS, "A", "Answer: A"), ("a", "q2", OPTIONS, "B", "Answer: A"), ("b", "q1", OPTIONS, "A", "Answer: B")]
    df = spark.createDataFrame(rows, "run string, question string, options array<string>, correct string, llm_answer string").repartition(2)
    path = str(tmp_path / "csv")
    run_csv.write_run_csv(df, path, separator)
    run_csv.write_run_csv(df.where("run = 'a'"), path, separator)
    got = run_csv.read_run_csv(spark, path, "*.csv", separator)
    assert {r["run"]: r["count"] for r in got.groupBy("run").count().collect()} == {"a": 2, "b": 1}
    run_csv.write_run_csv(df.where("run = 'a'"), path, separator, replace=False)
    assert run_csv.read_run_csv(spark, path, "*.csv", separator).where("run = 'a'").count() == 4


def test_foreign_short_and_long_records_are_set_aside(spark, run_folder):
    with open(f"{run_folder}/torn_test.csv", "w") as file:
        file.write("question,options,correct,llm_answer\n")
        file.write('"Q, ""x""\nline","[\'a\']",A,"Answer: A"\n')
        file.write('"Q2, cut",A\n')
        file.write('Q3,"[\'a\']",A,"Answer: A",shown\n')
        file.write('Q4,"[\'a\']",A,"Answer: A",shown,"more, yet"\n')
        file.write('Q5,"[\'a\']",B,\n')
    files = run_csv.RunFiles.scan(spark, run_folder, "*.csv")
    aside = sorted((r["file"], r["fault"], r["record"]) for r in files.quarantine().collect())
    assert [(f, why) for f, why, _ in aside] == [
        ("em_scores.csv", "foreign_header"), ("em_scores.csv", "foreign_header"),
        ("torn_test.csv", "long_record"), ("torn_test.csv", "long_record"), ("torn_test.csv", "short_record"),
    ]
    assert aside[3][2] == 'Q4,"[\'a\']",A,"Answer: A",shown,"more, yet"' and aside[4][2] == '"Q2, cut",A'
    assert sorted(r["run"] for r in files.records().select("run").distinct().collect()) == ["base_test", "shown_test", "torn_test"]
    torn = next(r for r in files.status().collect() if r["file"] == "torn_test.csv")
    assert (torn["status"], torn["n"], torn["blank"], torn["short"], torn["long"], torn["em"]) == ("ok", 2, 1, 1, 2, 0.5)


def test_a_score_sheet_among_result_files_is_no_run(spark, run_folder):
    tree = run_csv.read_run_csv_tree(spark, run_folder, "*.csv")
    assert {r["file"] for r in tree.select("file").distinct().collect()} == {"base_test", "shown_test"}
    assert "m1" not in {r["question"] for r in run_csv.read_run_csv(spark, run_folder, "*.csv").collect()}


def test_result_files_are_parsed_once(spark, run_folder):
    files = run_csv.RunFiles.scan(spark, run_folder, "*.csv")
    for df in (files.records(), files.quarantine(), files.status()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan csv" not in plan and "FileScan parquet" in plan


def test_no_matching_file(spark, tmp_path):
    assert run_csv.read_run_csv(spark, str(tmp_path)).collect() == []
    assert run_csv.run_file_status(spark, str(tmp_path)).collect() == []


def sheet_of(log):
    return {r["run"]: (r["n"], r["answered"], r["blank"], r["no_reference"], r["em"]) for r in log.sheet().collect()}


def test_a_sheet_grows_by_the_files_that_are_new(spark, run_folder, tmp_path_factory):
    log = ScoreLog(spark, str(tmp_path_factory.mktemp("log")), run_folder, n_shot=F.when(F.col("path").contains("shown"), 1).otherwise(0))
    assert sheet_of(log) == {}
    # Two files with records, and one with a header alone that is not read again.
    assert log.update() == 3 and log.update() == 0
    want = {"base_test": (4, 3, 1, 0, 0.5), "shown_test": (4, 3, 0, 0, 0.5)}
    assert sheet_of(log) == want
    more = pd.DataFrame({"question": ["Q"], "options": [str(OPTIONS)], "correct": ["A"], "llm_answer": ["Answer: A"]})
    more.to_csv(f"{run_folder}/a b+c%_test.csv", index=False)
    assert log.update() == 1
    assert sheet_of(log) == want | {"a b+c%_test": (1, 1, 0, 0, 1.0)}
    # A file that changes counts as it is now, one that goes counts no more.
    pd.concat([more, more.assign(correct="B")]).to_csv(f"{run_folder}/a b+c%_test.csv", index=False)
    os.rename(f"{run_folder}/base_test.csv", f"{run_folder}/base.old")
    assert log.update() == 1
    assert sheet_of(log) == {"shown_test": want["shown_test"], "a b+c%_test": (2, 2, 0, 0, 0.5)}
    whole = ScoreLog(spark, str(tmp_path_factory.mktemp("other")), run_folder, n_shot=F.when(F.col("path").contains("shown"), 1).otherwise(0))
    assert whole.update() == 3 and sheet_of(whole) == sheet_of(log)


def test_of_two_updates_at_once_one_counts(spark, run_folder, tmp_path_factory, monkeypatch):
    root = str(tmp_path_factory.mktemp("log"))
    one, two = (ScoreLog(spark, root, run_folder) for _ in range(2))
    listing = score_log.file_listing

    def meanwhile(*args):
        monkeypatch.setattr(score_log, "file_listing", listing)
        two.update()
        monkeypatch.setattr(one._log, "latest", lambda: None)
        return listing(*args)

    monkeypatch.setattr(score_log, "file_listing", meanwhile)
    with pytest.raises(RuntimeError, match="meanwhile"):
        one.update()
    assert sheet_of(two)["base_test"][0] == 4
