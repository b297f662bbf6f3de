from pyspark.sql import functions as F

from quizlake.operators import ledger as module
from quizlake.operators.ledger import RankLedger
from quizlake.operators.sampling import seeded_rank


def test_stretches_follow_the_seeded_order_and_end(spark, items, monkeypatch):
    monkeypatch.setattr(module, "_WIDTH", 7)
    some = items.where("item_id < 300").select("item_id", "question", F.lit(3).alias("n"))
    want = [r["item_id"] for r in seeded_rank(some, "item_id", 5).orderBy("rank").collect()]
    taken = RankLedger(some, "item_id", 5)
    at = 0
    for n in (1, 10, 3, 80, 50, 1000):
        rows = taken.take(n)
        assert rows.columns == some.columns and rows.schema["n"].dataType == some.schema["n"].dataType
        assert sorted(r["item_id"] for r in rows.collect()) == sorted(want[at : at + n])
        at += n
    assert taken.take(1) is None
    assert RankLedger(some.limit(0), "item_id", 5).take(4) is None


def test_a_stretch_reads_its_folders_only(spark, items, monkeypatch):
    monkeypatch.setattr(module, "_WIDTH", 10)
    taken = RankLedger(items.where("item_id < 500").select("item_id"), "item_id", 5)
    taken.take(100)
    rows = taken.take(25)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1][:200]
    assert rows.count() == 25
    # Of the forty folders laid out the stretch, ranks 101 to 125, covers three.
    files = {name.rsplit("_range=", 1)[1].split("/")[0] for name in rows.inputFiles()}
    assert files >= {"10", "11", "12"} and len(taken._slabs) == 1


def test_what_is_laid_out_follows_what_is_asked(spark, items):
    taken = RankLedger(items, "item_id", 1)
    taken.take(10)
    assert taken._laid() == 40
    taken.take(35)
    assert taken._laid() == 40 + 80
