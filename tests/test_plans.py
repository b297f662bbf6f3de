"""What the plans look like: where rows are shuffled, broadcast, or pass through one task."""

import re

import pytest
from pyspark.sql import functions as F

from quizlake.operators import fewshot, joins, sampling, scoring
from quizlake.plans import fixtures
from quizlake.plans.catalog import QUERIES

# Queries that call a responder in Python workers.
PYTHON = {"annotate_batch", "generate_and_score"}
# Written tables hide the plan behind them, and writing takes time: looked at elsewhere.
WRITING = {
    "annotate_until_target",
    "csv_file_status",
    "csv_grid_scored",
    "csv_quarantine",
    "csv_runs_scored",
    "database_scan",
    "em_by_run_colocated",
    "encoded_batches",
    "encoded_documents",
    "encoded_examples",
    "encoded_longest",
    "generate_and_score_modes",
    "pending_rows_colocated",
    "result_table_interleaved",
    "result_table_resumed",
    "runs_of_teacher_read",
    "runs_rewritten",
    "sample_grown",
    "score_sheet_grown",
    "split_scan",
}
# Reports of a few rows in order.
TOP_K = {"first_rows", "report_slice", "vocab_topk"}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()




@pytest.fixture()
def large(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_plan(large, folder, name):
    plan = physical(QUERIES[name].plan(large, folder))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InPandas" not in plan
    for single in re.finditer(r"Exchange SinglePartition[^\n]*\n(?P<below>.*)", plan, re.S):
        # Only counts per hash prefix, or the rows of a limit, may meet in one task.
        below = single["below"].split("\n")[0]
        assert "HashAggregate(keys=[_prefix" in below or "HashAggregate(keys=[], " in below or name in TOP_K, below


def test_filter_and_columns_reach_the_scan(spark, folder):
    items = fixtures.mcq(spark, folder)
    plan = physical(items.where("item_id = 5").select("correct"))
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,5)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint>" in plan


def test_small_samples_are_limited_before_the_shuffle(large, folder):
    df = sampling.sample_uniform(fixtures.responses(large, folder), 500, "response_id", 1)
    plan = physical(df)
    assert plan.index("row_number(), 500, Final") < plan.index("Exchange hashpartitioning(_prefix")
    assert plan.index("Exchange hashpartitioning(_prefix") < plan.index("row_number(), 500, Partial")
    # The counting pass reads nothing but the key.
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_only_prefix_counts_are_broadcast(large, folder):
    df = fewshot.letter_prompts(fixtures.mcq(large, folder), 2)
    plan = physical(df)
    broadcasts = re.findall(r"BroadcastExchange[^\n]*\n[^\n]*", plan)
    assert broadcasts and all("_prefix" in b and "_before" in b for b in broadcasts)


def test_large_references_meet_combined_replies(large, folder):
    replies, items = fixtures.responses(large, folder), fixtures.mcq(large, folder)
    plan = physical(scoring.score_runs(replies, items, ["run"], broadcast_bytes=0))
    join = plan.index("SortMergeJoin")
    assert "partial_count" in plan[join:]
    # One shuffle to combine, one for each side of the join, one for the runs.
    assert plan.count("Exchange hashpartitioning") == 4


def test_small_references_leave_replies_in_place(large, folder):
    replies, items = fixtures.responses(large, folder), fixtures.mcq(large, folder)
    plan = physical(scoring.score_runs(replies, items, ["run"]))
    assert plan.count("BroadcastExchange") == 1
    assert plan.count("Exchange hashpartitioning") == 1


def test_both_ways_give_the_same_scores(spark, folder):
    replies, items = fixtures.few_shot_responses(spark, folder), fixtures.mcq(spark, folder)
    scores = [
        scoring.score_runs(replies, items, ["run", "shots"], "shots", broadcast_bytes=limit)
        for limit in (0, 10**9)
    ]
    assert sorted(scores[0].collect()) == sorted(scores[1].collect())


def test_hot_key_is_split_over_tasks(large, folder):
    """A third of the rows on one key, joined by shuffle: no task gets them all."""
    rows = large.range(30_000).withColumn(
        "item_id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long")
    )
    table = large.range(30_000).withColumnRenamed("id", "item_id")
    df = joins.attach(rows, table, "item_id", hot_rows=1000)
    large.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        large.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(p["count"] for p in parts) == 30_000
    assert max(p["count"] for p in parts) < 7_500
