import pytest
from pyspark.sql import functions as F

from quizlake.operators import sampling, scoring
from quizlake.operators.joins import pending
from quizlake.plans import fixtures as fx
from quizlake.plans.runs import _colocated
from quizlake.sources import tables
from quizlake.sources.sample_store import SampleStore


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_replies_meet_items_in_their_buckets(spark, folder, no_broadcast):
    items, replies = _colocated(spark, folder)
    open_ = pending(items, replies.where("response is not null"), "item_id")
    plan = planned(open_)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    sheet = scoring.score_runs(replies, items, ["run"], broadcast_bytes=0)
    plan = planned(sheet)
    # The one shuffle is that of counts per run, above the join.
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("SortMergeJoin")
    flat = pending(fx.mcq(spark, folder), fx.responses(spark, folder).where("response is not null"), "item_id")
    assert open_.count() == flat.count()


def test_only_the_folders_of_wanted_runs_are_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(4000).select(F.concat(F.lit("run"), (F.col("id") % 40).cast("string")).alias("run"), "id")
    tables.write_responses(rows.repartition(2), path)
    runs = spark.createDataFrame([(f"run{i}", i) for i in range(40)], "run string, n int").where("n < 3")
    df = tables.read_runs(spark, path, runs)
    assert df.count() == 300
    plan = planned(df)
    assert "dynamicpruning" in plan
    counted = df.groupBy("run").count()
    counted.collect()

    def scans(node):
        found = [node] if node.nodeName().startswith("Scan parquet") else []
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        children = node.children()
        return found + [s for n in [*inner, *(children.apply(i) for i in range(children.size()))] for s in scans(n)]

    files = [s.metrics().apply("numFiles").value() for s in scans(counted._jdf.queryExecution().executedPlan())]
    assert files and max(files) <= 3 * 2


@pytest.mark.parametrize("letter", ["correct", None])
def test_a_kept_sample_is_that_of_everything(spark, tmp_path, items, letter):
    some = items.select("item_id", "correct", "kind")
    store = SampleStore(spark, str(tmp_path / "s"), 60, letter=letter)
    with pytest.raises(ValueError):
        store.sample(3)
    parts = ["item_id % 7 = 0", "item_id % 7 in (1, 2, 3)", "item_id < 0", "item_id % 7 > 3"]
    for i, part in enumerate(parts):
        store.update(some.where(part))
        so_far = some.where(" or ".join(f"({p})" for p in parts[: i + 1]))
        for n in (1, 33, 60):
            whole = sampling.sample_stratified(so_far, n, "item_id", 42) if letter else sampling.sample_uniform(so_far, n, "item_id", 42)
            assert {r["item_id"] for r in store.sample(n).collect()} == {r["item_id"] for r in whole.collect()}
    assert store.rows().count() <= 60 * (5 if letter else 1)
    with pytest.raises(ValueError):
        store.sample(400)
    with pytest.raises(ValueError, match="was made with"):
        SampleStore(spark, str(tmp_path / "s"), 60, seed=1, letter=letter).rows()


def test_two_updates_at_once_lose_nothing(spark, tmp_path, items, monkeypatch):
    some = items.select("item_id", "correct")
    one, two = (SampleStore(spark, str(tmp_path / "s"), 40) for _ in range(2))
    put = one._log.put

    def meanwhile(number, entry):
        monkeypatch.setattr(one._log, "put", put)
        two.update(some.where("item_id % 2 = 1"))
        return put(number, entry)

    monkeypatch.setattr(one._log, "put", meanwhile)
    one.update(some.where("item_id % 2 = 0"))
    want = {r["item_id"] for r in sampling.sample_stratified(some, 100, "item_id", 42).collect()}
    assert {r["item_id"] for r in one.sample(100).collect()} == want
