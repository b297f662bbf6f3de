import ast
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.functions import options as opt
from quizlake.operators import items as prep

TEXT = st.text(alphabet="ab1 ,'\"\\\n\tné)", max_size=8)


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=st.lists(st.lists(TEXT, min_size=1, max_size=5), min_size=1, max_size=20))
def test_list_text_is_read_by_python_and_back(spark, batch):
    df = spark.createDataFrame([(row,) for row in batch], "o array<string>")
    text = opt.options_to_list_text(F.col("o"))
    rows = df.select("o", text.alias("t"), opt.options_from_list_text(text).alias("back")).collect()
    for row in rows:
        assert ast.literal_eval(row["t"]) == row["o"]
        assert row["back"] == row["o"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=st.lists(st.lists(TEXT, min_size=1, max_size=5), min_size=1, max_size=20))
def test_python_lists_and_json_are_read(spark, batch):
    rows = [(repr(row), json.dumps(row)) for row in batch]
    df = spark.createDataFrame(rows, "l string, j string")
    read = df.select(
        opt.options_from_list_text(F.col("l")).alias("l"), opt.options_from_json(F.col("j")).alias("j")
    ).collect()
    assert [row["l"] for row in read] == batch
    assert [row["j"] for row in read] == batch


def test_escaped_quotes_need_json(spark):
    text = '["A)say \\"x\\"","B)","C)3","D)4","E)5"]'
    parsed = one(spark, text, "t string", opt.options_from_json(F.col("t")))
    scanned = one(spark, text, "t string", opt.options_from_quotes(F.col("t")))
    assert parsed == ['A)say "x"', "B)", "C)3", "D)4", "E)5"]
    assert scanned[:2] == ["A)say \\", ","]


def test_malformed_text_gives_null(spark):
    assert one(spark, "[1,", "t string", opt.options_from_json(F.col("t"))) is None
    assert one(spark, "nan", "t string", opt.options_from_list_text(F.col("t"))) is None


def test_letters_outside_the_list_give_null(spark):
    df = spark.createDataFrame(
        [(["x", "y"], "B"), (["x", "y"], "E"), (["x"], "!"), (None, "A"), (["x"], None)],
        "options array<string>, correct string",
    )
    got = [row["answer_text"] for row in prep.add_correct_text(df).collect()]
    assert got == ["y", None, None, None, None]


def test_every_reason(spark):
    five = list("vwxyz")
    df = spark.createDataFrame(
        [(five, "A"), (None, "A"), (five[:4], "A"), (five, "F"), (five, None)],
        "options array<string>, correct string",
    )
    usable, bad = prep.split_usable(df)
    assert usable.count() == 1
    assert sorted(row["reason"] for row in bad.collect()) == [
        "bad_letter",
        "bad_letter",
        "bad_options",
        "option_count",
    ]


def test_lettering_and_spread(spark):
    df = spark.createDataFrame([(["1", "2", "3"],)], "o array<string>")
    row = df.select(
        opt.lettered(F.col("o")).alias("a"),
        opt.lettered(F.col("o"), ":").alias("b"),
        opt.comma_joined(F.col("o")).alias("c"),
        opt.comma_spread(F.lit('["a"]')).alias("d"),
    ).first()
    assert tuple(row) == ("A: 1, B: 2, C: 3", "A:1, B:2, C:3", "1, 2, 3", '[, ", a, ", ]')


def test_preparing_answer_columns(spark):
    df = spark.createDataFrame([(1, "why")], "item_id long, rationale string")
    ready = prep.add_answer_columns(prep.drop_rationale(df))
    assert ready.columns == ["item_id", "LLMs_rationale", "LLMs_answer", "status"]
    assert prep.drop_rationale(ready).columns == ready.columns
    assert tuple(ready.first()) == (1, None, None, "pending")


def test_a_null_option_is_a_problem(spark):
    df = spark.createDataFrame([(["a", None, "c", "d", "e"], "A"), (list("abcde"), "A")], "options array<string>, correct string")
    assert [r[0] for r in df.select(opt.shape_problem(F.col("options"), F.col("correct"))).collect()] == ["null_option", "ok"]
