from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quizlake.operators import fewshot


def frame(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "item_id long")
    return df.select(
        "item_id",
        F.concat(F.lit("q"), "item_id").alias("question"),
        F.array(F.lit("a"), F.lit("b")).alias("options"),
        F.lit("A").alias("correct"),
        F.concat(F.lit("because "), "item_id").alias("rationale"),
    )


def drawn(df):
    out = defaultdict(dict)
    for row in df.collect():
        assert row["slot"] not in out[row["item_id"]]
        out[row["item_id"]][row["slot"]] = row["ex_id"]
    return {key: [slots[i] for i in sorted(slots)] for key, slots in out.items()}


@pytest.mark.parametrize("n_shot", [1, 2, 5])
def test_never_itself_never_twice(spark, n_shot):
    got = drawn(fewshot.draw_examples(frame(spark, range(400)), n_shot, seed=3))
    assert len(got) == 400
    for key, examples in got.items():
        assert len(examples) == n_shot == len(set(examples))
        assert key not in examples


def test_every_other_row_is_as_likely(spark):
    counts = Counter()
    for seed in range(8):
        for key, examples in drawn(fewshot.draw_examples(frame(spark, range(6)), 5, seed=seed)).items():
            # With five shots out of six rows each question sees all the others, in varying order.
            assert sorted(examples) == [k for k in range(6) if k != key]
            counts[examples[0]] += 1
    assert set(counts) == set(range(6))


def test_draw_ignores_layout(spark):
    df = frame(spark, range(300))
    runs = [
        drawn(fewshot.draw_examples(df.repartition(parts), 2, seed=5)) for parts in (1, 3, 17)
    ]
    assert runs[0] == runs[1] == runs[2]


def test_pool_smaller_than_wanted(spark):
    got = drawn(fewshot.draw_examples(frame(spark, range(3)), 5, seed=1))
    assert {key: sorted(examples) for key, examples in got.items()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}


def test_pool_of_other_rows(spark):
    questions, pool = frame(spark, range(50)), frame(spark, range(40, 60))
    got = drawn(fewshot.draw_examples(questions, 3, seed=2, pool=pool))
    assert len(got) == 50
    for key, examples in got.items():
        assert len(set(examples)) == 3 and key not in examples
        assert set(examples) <= set(range(40, 60))


def test_prompts_follow_the_draw(spark):
    df = frame(spark, range(30))
    picks = drawn(fewshot.draw_examples(df, 2, seed=4))
    for row in fewshot.rationale_prompts(df, 2, seed=4).collect():
        blocks = [
            f"Instruction: q{k} options: a, b\nOutput: because {k} Answer: A\n\n" for k in picks[row["item_id"]]
        ]
        own = f"Instruction: q{row['item_id']} options: a, b\nOutput: "
        assert row["few_shot_prompt"] == "".join(blocks) + own


def test_lone_question_has_no_examples(spark):
    row = fewshot.letter_prompts(frame(spark, [1]), 2).first()
    assert row["few_shot_prompt"] == "Instruction: q1 options: a, b\nOutput: "


def test_at_least_one_shot(spark):
    with pytest.raises(ValueError):
        fewshot.draw_examples(frame(spark, [1]), 0)
