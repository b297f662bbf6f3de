from pyspark.sql import functions as F

from quizlake.functions import extract, runnames
from quizlake.operators import encode
from quizlake.operators.rescore import reextract, score_table, write_score_sheet
from quizlake.operators.sampling import _digits
from quizlake.sources.result_table import ResultTable


def test_answers_follow_the_new_rule(spark, tmp_path):
    table = ResultTable(spark, str(tmp_path / "t")).create()
    rows = [(1, "Answer: A", "N/A", "unparsed", "A"), (2, "none", "B", "answered", "B"), (3, None, None, "pending", "C")]
    table.append(
        spark.createDataFrame(rows, "item_id long, LLMs_rationale string, LLMs_answer string, status string, correct string")
        .withColumns({"question": F.lit("q"), "options": F.array(F.lit("x"))})
    )
    reextract(table, extract.last_letter)
    got = {r["item_id"]: (r["LLMs_answer"], r["status"]) for r in table.read().collect()}
    assert got == {1: ("A", "answered"), 2: (None, "unparsed"), 3: (None, "pending")}
    sheet = score_table(table, [F.lit("all").alias("run")])
    assert sheet.first()["em"] == 0.5
    write_score_sheet(sheet.select("run", "em"), str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).first().asDict() == {"run": "all", "em": "0.5"}


def test_names_of_known_data_sets(spark):
    names = ["full_finetune_t5-base_aqua_rat500", "kd_lora_finetune_t5_gsm8k500"]
    df = spark.createDataFrame([(n,) for n in names], "run string")
    fields = runnames.run_fields(F.col("run"), ["aqua_rat", "gsm8k"])
    got = [(r.f["base_model"], r.f["dataset"], r.f["n_train"]) for r in df.select(fields.alias("f")).collect()]
    assert got == [("t5-base", "aqua_rat", 500), ("t5", "gsm8k", 500)]


def test_either_order_of_the_flags(spark):
    no, yes = F.lit(None).cast("long"), F.lit(True)
    name = runnames.causal_run_name(F.lit("m"), F.lit("d"), yes, yes, F.lit(2000), no, no, teacher_first=True)
    assert spark.range(1).select(name).first()[0] == "m-finetuned-d-teacher-AM-2k"


def test_vocabulary_with_ties_at_the_cut(spark):
    df = spark.createDataFrame([("b b a c d e",), ("f g a h",)], "text string").repartition(2)
    got = [(r["token"], r["n"]) for r in encode.build_vocabulary(df, "text", 4).orderBy("token_id").collect()]
    assert got == [("a", 2), ("b", 2), ("c", 1), ("d", 1)]
    assert encode.build_vocabulary(df.where("text is null"), "text", 4).collect() == []


def test_groups_of_a_ranking_stay_small():
    for rows in (10, 10**9, 10**12):
        assert rows / (15 * 16 ** (_digits(rows) - 1)) <= 1_000_000
