import pytest
from pyspark.sql import functions as F

from quizlake.functions import compare, extract
from quizlake.operators import joins, scoring


def sheet(spark, rows, **options):
    df = spark.createDataFrame(rows, "run string, pred string, ref string")
    return {r["run"]: r for r in scoring.score_sheet(df, ["run"], "pred", "ref", **options).collect()}


ROWS = [("r", "A", "A"), ("r", None, "B"), ("r", None, None), ("r", "C", None)]


@pytest.mark.parametrize(
    "mode, em, no_reference", [("default", 0.5, 2), ("legacy", 0.5, 0), ("nullsafe", 0.5, 0)]
)
def test_missing_values(spark, mode, em, no_reference):
    row = sheet(spark, ROWS, mode=mode)["r"]
    assert (row["n"], row["answered"], row["no_reference"], row["em"]) == (4, 2, no_reference, em)


def test_unreadable_replies_stay_in_the_mean(spark):
    assert sheet(spark, [("r", "A", "A"), ("r", None, "A"), ("r", None, "B")])["r"]["em"] == 0.333333


def test_no_reference_at_all_gives_no_score(spark):
    assert sheet(spark, [("r", "A", None)])["r"]["em"] is None


def test_normalising_ignores_case_and_punctuation(spark):
    rows = [("r", "4.2", "42"), ("r", "-5", "5"), ("r", "b.", "B"), ("r", "x", "y")]
    assert sheet(spark, rows)["r"]["em"] == 0.0
    assert sheet(spark, rows, normalise=True)["r"]["em"] == 0.75


def test_weights_stand_for_rows(spark):
    rows = [("a", "A", "A")] * 7 + [("a", None, "A")] * 2 + [("b", "B", "A")] + [("a", "A", None)] * 3
    df = spark.createDataFrame(rows, "run string, pred string, ref string")
    plain = scoring.score_sheet(df, ["run"], "pred", "ref").orderBy("run").collect()
    tallied = scoring.tally(df, df.columns)
    weighted = scoring.score_sheet(tallied, ["run"], "pred", "ref", weight="_n").orderBy("run").collect()
    assert plain == weighted


def test_bad_mode(spark):
    with pytest.raises(ValueError):
        sheet(spark, ROWS, mode="other")


def test_runs_count_items_without_reference(spark):
    items = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "item_id long, correct string")
    replies = spark.createDataFrame(
        [
            ("r", 1, "Answer: A"),
            ("r", 2, "Answer: A"),
            ("r", 2, None),
            ("r", 3, "Answer: A"),
            ("r", 9, "Answer: A"),
            ("r", None, "no idea"),
        ],
        "run string, item_id long, response string",
    )
    row = scoring.score_runs(replies, items, ["run"]).first()
    assert row.asDict() == {
        "run": "r",
        "n": 6,
        "answered": 4,
        "blank": 1,
        "no_reference": 3,
        "em": 0.333333,
    }


def test_letters_of_examples_do_not_count(spark):
    items = spark.createDataFrame([(1, "A")], "item_id long, correct string")
    text = "Answer: A\n\nOutput: "
    replies = spark.createDataFrame(
        [("r", 1, text + "Answer: A", 1), ("r", 1, text + "hm", 1), ("r", 1, "Answer: A", 0)],
        "run string, item_id long, response string, shots int",
    )
    assert scoring.score_runs(replies, items, ["run"], shots="shots").first()["em"] == 0.666667
    assert scoring.score_runs(replies, items, ["run"], shots=2).first()["em"] == 0.0
    assert scoring.score_runs(replies, items, ["run"]).first()["em"] == 1.0


def test_numeric_scores(spark):
    df = spark.createDataFrame(
        [
            ("r", "so 1,200", "#### 1,200"),
            ("r", "so -1200", "#### 1200"),
            ("r", "about 1200.", "#### 1200"),
            ("r", "no", "#### none"),
            ("r", None, "#### 5"),
            ("r", "7", None),
        ],
        "run string, response string, answer string",
    )
    row = scoring.score_numeric(df, ["run"], "response", "answer").first()
    assert (row["n"], row["answered"], row["no_reference"]) == (6, 4, 1)
    assert (row["em"], row["em_strict"]) == (0.6, 0.4)


def test_text_accuracy_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "pred string, answer string")
    row = scoring.text_accuracy(df, [], "pred", "answer").first()
    assert row["accuracy"] is None


def test_verdict_ignores_case(spark):
    df = spark.createDataFrame([("a", "A"), ("b", "A"), (None, None), (None, "A")], "p string, r string")
    got = [r[0] for r in df.select(compare.verdict(F.col("p"), F.col("r"))).collect()]
    assert got == ["Correct", "Incorrect", "Correct", "Incorrect"]


def test_valid_counts_and_first_letters(spark):
    df = spark.createDataFrame([("r", "A"), ("r", "N/A"), ("r", None), ("r", "")], "run string, answer string")
    row = scoring.valid_counts(df, ["run"], "answer").first()
    assert (row["n"], row["valid"], row["pending"]) == (4, 2, 1)
    letters = {r["letter"]: r["n"] for r in scoring.first_letters(df, "answer").collect()}
    assert letters == {"A": 1, "N": 1}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [None, 1, 100, 10**9])
def test_hot_keys_change_no_row(spark, how, hot_rows):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40)
    rows = spark.range(3000).withColumn("item_id", key.cast("long"))
    table = spark.range(30).select(F.col("id").alias("item_id"), (F.col("id") * 2).alias("v"))
    mine = joins.attach(rows, table, "item_id", how, hot_rows, broadcast_bytes=0)
    plain = rows.join(table, "item_id", how)
    assert mine.columns == plain.columns
    assert sorted(mine.collect(), key=str) == sorted(plain.collect(), key=str)


def test_hot_key_is_spread_over_salts(spark):
    rows = spark.range(2000).withColumn("item_id", F.lit(5).cast("long"))
    table = spark.range(10).withColumnRenamed("id", "item_id")
    df = joins.attach(rows, table, "item_id", hot_rows=10, broadcast_bytes=0)
    assert df.count() == 2000
    # The salt is part of the join, so that a shuffled join has more than one task for the key.
    assert "_salt" in df._jdf.queryExecution().optimizedPlan().toString()


def test_attach_modes(spark):
    with pytest.raises(ValueError):
        joins.attach(spark.range(1), spark.range(1), "id", "full")


def test_pending_and_missing(spark):
    items = spark.range(6).withColumnRenamed("id", "item_id")
    done = spark.createDataFrame([(1,), (1,), (4,)], "item_id long")
    assert sorted(r[0] for r in joins.pending(items, done, "item_id").collect()) == [0, 2, 3, 5]
    expected = spark.createDataFrame([("a",), ("b",), ("b",)], "run string")
    present = spark.createDataFrame([("a",)], "run string")
    assert [r[0] for r in joins.missing_runs(expected, present).collect()] == ["b"]


def test_row_verdicts_keep_every_reply(spark):
    items = spark.createDataFrame([(1, "A")], "item_id long, correct string")
    replies = spark.createDataFrame(
        [(1, 1, "Answer: a"), (2, 1, "Answer: b"), (3, 9, "Answer: a"), (4, 1, None)],
        "response_id long, item_id long, response string",
    )
    rows = scoring.row_verdicts(replies, items, extract.last_letter).orderBy("response_id").collect()
    assert [r["verdict"] for r in rows] == ["Correct", "Incorrect", "Incorrect", "Incorrect"]


def test_rows_without_a_key_are_spread(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, null, id % 50) AS item_id")
    table = spark.range(50).selectExpr("id AS item_id", "'x' AS correct")
    joined = joins.attach(rows, table, "item_id", "left", hot_rows=1000, broadcast_bytes=0)
    assert joined.count() == 3000 and joined.where("item_id is null and correct is null").count() == 1000


def test_means_agree_where_references_are_missing(spark):
    from quizlake.operators import leaderboard

    items = spark.createDataFrame([(1, "A"), (2, None)], "item_id long, correct string")
    replies = spark.createDataFrame([(1, "r", "s", "Answer: A"), (2, "r", "s", "Answer: B")], "item_id long, run string, shots string, response string")
    counts = scoring.run_counts(replies, items, ["run", "shots"])
    assert scoring.score_runs(replies, items, ["run"]).first()["em"] == 1.0
    assert leaderboard.leaderboard(counts, ["run"]).where("run = 'r'").first()["em"] == 1.0
    assert leaderboard.by_shots(counts, ["run"]).first()["s"] == 1.0
    with pytest.raises(Exception, match="unlisted shot setting: s"):
        leaderboard.by_shots(counts, ["run"], ["other"]).collect()
