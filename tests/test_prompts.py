import pytest
from pyspark.sql import functions as F

from quizlake import fixed_values as fv
from quizlake.functions import options as opt
from quizlake.functions import prompts as p

Q = "How many?"
OPTIONS = ["A)1", "B)2", "C)3", "D)4", "E)5"]
WHY = "  First step.\n\nSo, The answer is: B\n\nthe answer is: kept\n"


@pytest.fixture(scope="module")
def row(spark):
    df = spark.createDataFrame([(Q, OPTIONS, "B", WHY)], "q string, o array<string>, c string, w string")
    q, o, c, w = (F.col(name) for name in "qocw")
    return df.select(
        p.seq2seq_input(q, o).alias("train"),
        p.seq2seq_input(q, o, final_stop=True).alias("eval"),
        p.seq2seq_distil_input(q, o, w).alias("distil"),
        p.zero_shot(q, o).alias("zero"),
        p.zero_shot(q, o, F.lit("before")).alias("more"),
        p.instruct_text(q, opt.comma_joined(o), F.lit("why")).alias("instruct"),
        p.instruct_text(q, opt.comma_joined(o), F.lit("why"), "legacy").alias("legacy"),
        p.letter_example(q, o, c).alias("letter"),
        p.rationale_example(q, o, F.lit("why"), c).alias("reasoned"),
        p.teacher_mcq(q, o).alias("teacher"),
        p.teacher_numeric(q).alias("numeric"),
        p.step_by_step(q, o).alias("steps"),
        p.from_template("{prompt}|{options_text}|{prompt}", q, o).alias("filled"),
        p.from_template("{prompt}", F.lit("see {options_text}"), o).alias("twice"),
    ).first()


JOINED = "A)1, B)2, C)3, D)4, E)5"
LETTERED = "A:A)1, B:B)2, C:C)3, D:D)4, E:E)5"
ZERO = f"Instruction: How many? options: {JOINED}\nOutput: "


@pytest.mark.parametrize(
    "name, text",
    [
        ("train", "question: How many? options: A)1 B)2 C)3 D)4 E)5"),
        ("eval", "question: How many? options: A)1 B)2 C)3 D)4 E)5."),
        (
            "distil",
            "question: How many? options: A)1 B)2 C)3 D)4 E)5, First step.\n\nthe answer is: kept",
        ),
        ("zero", ZERO),
        ("more", "before" + ZERO),
        ("instruct", ZERO + "why"),
        ("legacy", f"Instruction: How many? options: {JOINED}\\Output: why"),
        ("letter", ZERO + "Answer: B\n\n"),
        ("reasoned", ZERO + "why Answer: B\n\n"),
        ("teacher", "How many?\n\nOptions: A: A)1, B: B)2, C: C)3, D: D)4, E: E)5"),
        ("numeric", fv.NUMERIC_INSTRUCTION + Q),
        ("steps", f"Question: How many?\nAnswer choices: {LETTERED}.\n{fv.STEP_INSTRUCTION}"),
        ("filled", f"{Q}|{LETTERED}|{Q}"),
        ("twice", f"see {LETTERED}"),
    ],
)
def test_text(row, name, text):
    assert row[name] == text
