import os

import pytest
from pyspark.sql import functions as F

from quizlake.functions import prompts
from quizlake.functions.extract import last_letter
from quizlake.operators import annotate as ann
from quizlake.operators import evaluation
from quizlake.operators import items as prep
from quizlake.sources.result_table import ResultTable


@pytest.fixture()
def asked(items):
    ready = prep.drop_rationale(items).where("item_id < 200")
    return ready.withColumn("prompt", prompts.teacher_mcq(F.col("question"), F.col("options")))


def logging_responder(folder, refuse_after=None):
    """Answers every prompt and leaves one line per prompt asked."""

    def make():
        def respond(batch):
            with open(os.path.join(folder, f"{os.getpid()}.log"), "a") as log:
                log.writelines(prompt.split("?")[0] + "\n" for prompt in batch)
            return ["Answer: A" for _ in batch]

        return respond

    return make


def asked_lines(folder):
    lines = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name)) as log:
            lines += log.read().split("\n")[:-1]
    return lines


def test_errors_stay_with_their_row(spark):
    def make():
        def respond(batch):
            if any("bad" in prompt for prompt in batch):
                raise RuntimeError("no " + batch[0])
            return [prompt.upper() for prompt in batch]

        return respond

    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "good"), (4, None)], "item_id long, prompt string")
    rows = {r["item_id"]: r for r in ann.annotate(df.coalesce(1), make, ["item_id"], retries=2).collect()}
    assert set(rows) == {1, 2, 3}
    assert (rows[1]["response"], rows[1]["error"]) == ("FINE", None)
    assert (rows[3]["response"], rows[3]["error"]) == ("GOOD", None)
    assert rows[2]["response"] is None and rows[2]["attempts"] == 3
    assert rows[2]["error"] == "RuntimeError: no bad"


def test_short_batches_are_asked_row_by_row(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "item_id long, prompt string")
    rows = ann.annotate(df.coalesce(1), lambda: lambda batch: [batch[0]], ["item_id"]).collect()
    assert all(r["response"] == f"p{r['item_id']}" for r in rows)


def test_responder_is_made_once_per_task(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        with open(os.path.join(folder, "made.log"), "a") as log:
            log.write("made\n")
        return lambda batch: batch

    df = spark.range(1000).select(F.col("id").alias("item_id"), F.lit("p").alias("prompt"))
    assert ann.annotate(df, make, ["item_id"], partitions=3).count() == 1000
    with open(os.path.join(folder, "made.log")) as log:
        assert len(log.readlines()) <= 3


def test_runs_are_rows(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q")], "item_id long, prompt string")
    pairs = lambda: lambda batch, runs: [f"{run}:{prompt}" for prompt, run in zip(batch, runs)]
    rows = ann.annotate_runs(df, ["x", "y"], pairs).collect()
    assert sorted((r["run"], r["item_id"], r["response"]) for r in rows) == [
        ("x", 1, "x:p"),
        ("x", 2, "x:q"),
        ("y", 1, "y:p"),
        ("y", 2, "y:q"),
    ]


def test_target_is_met_exactly(spark, tmp_path, asked):
    table = ResultTable(spark, str(tmp_path / "t")).create()
    done = ann.annotate_until(asked, table, ann.template_responder, last_letter, 50)
    assert done.count() == 50
    stored = table.read()
    assert stored.select("item_id").distinct().count() == stored.count()
    assert {r["status"] for r in stored.collect()} <= {"answered", "unparsed"}


def test_resuming_asks_nothing_twice(spark, tmp_path, asked):
    folder = str(tmp_path / "log")
    os.mkdir(folder)
    table = ResultTable(spark, str(tmp_path / "t")).create()
    ann.annotate_until(asked, table, logging_responder(folder), last_letter, 40)
    ann.annotate_until(asked, table, logging_responder(folder), last_letter, 90)
    ann.annotate_until(asked, table, logging_responder(folder), last_letter, 90)
    assert table.read().count() == 90 == len(asked_lines(folder))


def test_a_crashed_round_is_made_up_for(spark, tmp_path, asked):
    table = ResultTable(spark, str(tmp_path / "t")).create()

    def broken():
        raise SystemError("the client would not start")

    with pytest.raises(Exception, match="would not start"):
        ann.annotate_until(asked, table, broken, last_letter, 30)
    assert table.read().count() == 0
    assert ann.annotate_until(asked, table, ann.template_responder, last_letter, 30).count() == 30


def test_stops_when_nothing_is_pending(spark, tmp_path, asked):
    table = ResultTable(spark, str(tmp_path / "t")).create()
    done = ann.annotate_until(asked, table, ann.template_responder, last_letter, 10_000)
    assert table.read().count() == 200
    assert done.count() == table.read().where("status = 'answered'").count() < 200


def test_useless_responder_ends_too(spark, tmp_path, asked):
    table = ResultTable(spark, str(tmp_path / "t")).create()

    def make():
        return lambda batch: ["hm" for _ in batch]

    assert ann.annotate_until(asked, table, make, last_letter, 60).count() == 0
    assert table.read().count() == 200


def test_seeded_rows_are_pending(spark, tmp_path, asked):
    table = ResultTable(spark, str(tmp_path / "t")).create()
    table.seed(prep.add_answer_columns(asked))
    assert ann.annotate_until(asked, table, ann.template_responder, last_letter, 20).count() == 20
    table.compact()
    assert table.read().count() == 200


def test_items_without_a_prompt_are_never_in_the_way(spark, tmp_path, asked):
    from quizlake.operators.sampling import seeded_rank

    ranked = seeded_rank(asked, "item_id", 42)
    some = ranked.withColumn("prompt", F.when(F.col("rank") > 40, F.col("prompt"))).drop("rank")
    table = ResultTable(spark, str(tmp_path / "t")).create()
    done = ann.annotate_until(some, table, ann.template_responder, last_letter, 30, seed=42)
    assert done.count() == 30 and all(r["target_met"] for r in done.collect())
    short = ann.annotate_until(some, table, ann.template_responder, last_letter, 10_000, seed=42)
    assert table.read().count() == 160 and not short.first()["target_met"]


def test_rounds_may_be_limited_but_not_in_silence(spark, tmp_path, asked):
    table = ResultTable(spark, str(tmp_path / "t")).create()
    with pytest.raises(RuntimeError, match="0 of 5 valid"):
        ann.annotate_until(asked, table, lambda: lambda batch: ["hm"] * len(batch), last_letter, 5, max_rounds=2)


def test_errors_are_stored_with_the_reply(spark, tmp_path, asked):
    def make():
        def respond(batch):
            raise RuntimeError("down")

        return respond

    table = ResultTable(spark, str(tmp_path / "t")).create()
    ann.annotate_until(asked.limit(3), table, make, last_letter, 1, retries=1)
    rows = table.read().collect()
    assert len(rows) == 3 and all((r["error"], r["attempts"], r["status"]) == ("RuntimeError: down", 2, "unparsed") for r in rows)


def test_modes_and_runs_are_asked_in_one_pass(spark, tmp_path, items):
    folder = str(tmp_path)
    some = items.where("item_id < 30").withColumn("rationale", F.lit("Because."))

    def echo():
        def respond(batch, runs):
            with open(os.path.join(folder, f"{os.getpid()}.log"), "a") as log:
                log.writelines(f"{run}\n" for run in runs)
            return [p + ("Answer: B" if run == "b" else "no idea") for p, run in zip(batch, runs)]

        return respond

    sheet = evaluation.generate_and_score(some, ["a", "b"], [("zero_shot", 0), ("letter", 1), ("rationale", 2)], echo)
    got = {(r["run"], r["mode"], r["n_shot"]): (r["n"], r["answered"], r["em"]) for r in sheet.collect()}
    share = round(some.where("correct = 'B'").count() / 30, 6)
    # The letters of the examples that stand in the reply are nobody's answer.
    modes = [("zero_shot", 0), ("letter", 1), ("rationale", 2)]
    assert got == {("a", *m): (30, 0, 0.0) for m in modes} | {("b", *m): (30, 30, share) for m in modes}
    assert sorted(asked_lines(folder)) == ["a"] * 90 + ["b"] * 90
    with pytest.raises(ValueError):
        evaluation.mode_prompts(some, [("zero_shot", 1)])
