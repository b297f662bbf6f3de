import pytest
from pyspark.sql import functions as F

from quizlake.functions import runnames
from quizlake.operators import leaderboard

FIELDS = ["kd", "method", "base_model", "dataset", "n_train", "layers", "r", "alpha"]
CASES = {
    "full_finetune_t5-small_custom500": (False, "full", "t5-small", "custom", 500, None, None, None),
    "./t5-base/kd_lora_finetune_t5-base_custom2000": (
        True, "lora", "t5-base", "custom", 2000, None, None, None,
    ),
    "org/phi-1_5-finetuned-maths-set-0.5k": (
        False, "lora", "phi-1_5", "maths-set", 500, "all", None, None,
    ),
    "phi-1_5-finetuned-maths-set-teacher-AM-2k": (
        True, "lora", "phi-1_5", "maths-set", 2000, "attention", None, None,
    ),
    "phi-1_5-finetuned-maths-set-AM-teacher-2k-r-24": (
        True, "lora", "phi-1_5", "maths-set", 2000, "attention", 24, None,
    ),
    "phi-1_5-finetuned-maths-set-AM-teacher-2k-alpha-8_test": (
        True, "lora", "phi-1_5", "maths-set", 2000, "attention", None, 8,
    ),
    "phi-1_5-finetuned-maths-set-AM-5k": (
        False, "lora", "phi-1_5", "maths-set", 5000, "attention", None, None,
    ),
    "something else": (None,) * 8,
}


@pytest.mark.parametrize("name", CASES)
def test_fields(spark, name):
    df = spark.createDataFrame([(name,)], "run string")
    row = leaderboard.with_run_fields(df).first()
    assert tuple(row[field] for field in FIELDS) == CASES[name]


def test_name_is_built_and_read_back(spark):
    df = spark.createDataFrame([(True, "lora", "t5-base", "custom", 1000)], "kd boolean, m string, b string, d string, n long")
    name = runnames.seq2seq_run_name(*[F.col(c) for c in ("kd", "m", "b", "d", "n")])
    row = leaderboard.with_run_fields(df.select(name.alias("run"))).first()
    assert row["run"] == "kd_lora_finetune_t5-base_custom1000"
    assert (row["kd"], row["method"], row["base_model"], row["dataset"], row["n_train"]) == (
        True, "lora", "t5-base", "custom", 1000,
    )


@pytest.mark.parametrize(
    "n_train, text", [(500, "0.5k"), (1000, "1k"), (2000, "2k"), (10000, "10k"), (1250, "1.25k"), (100, "0.1k")]
)
def test_thousands(spark, n_train, text):
    df = spark.createDataFrame([(n_train,)], "n long")
    no = F.lit(False)
    nothing = F.lit(None).cast("long")
    name = runnames.causal_run_name(F.lit("m"), F.lit("d"), no, no, F.col("n"), nothing, nothing)
    assert df.select(name).first()[0] == f"m-finetuned-d-{text}"


@pytest.mark.parametrize("path, stem", [("a/b/run_test.csv", "run_test"), ("x-1.5k.csv", "x-1.5k"), ("a/b/", "b")])
def test_file_stem(spark, path, stem):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(runnames.file_stem(F.col("p"))).first()[0] == stem


def test_rollup_levels(spark):
    df = spark.createDataFrame(
        [("x", "zero_shot", 10, 1), ("x", "one_shot", 10, 3), ("y", "zero_shot", 20, 10)],
        "method string, shots string, n long, hits long",
    )
    rows = {(r["level"], r["method"], r["shots"]): (r["n"], r["em"]) for r in leaderboard.leaderboard(df, ["method", "shots"]).collect()}
    assert rows[(0, None, None)] == (40, 0.35)
    assert rows[(1, "x", None)] == (20, 0.2)
    assert rows[(2, "y", "zero_shot")] == (20, 0.5)
    wide = {r["method"]: r for r in leaderboard.by_shots(df, ["method"], ["zero_shot", "one_shot", "one_shot_cot"]).collect()}
    assert (wide["x"]["zero_shot"], wide["x"]["one_shot"], wide["x"]["one_shot_cot"]) == (0.1, 0.3, None)
