import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from quizlake.sources import database_file as db


@pytest.fixture()
def file(tmp_path):
    """A results table as a script keeps it: texts, nulls, gaps in the row ids, odd names."""
    path = str(tmp_path / "re sults.db")
    connection = sqlite3.connect(path)
    connection.execute('CREATE TABLE "LLM results" (question TEXT, n INTEGER, share REAL, "odd ""name" TEXT, raw BLOB, "when" DATE)')
    rows = [(f"q{i} é\n'x'", i if i % 7 else None, i / 4, str(i) if i % 3 else None, bytes([i % 256]), "2024-01-02") for i in range(1000)]
    connection.executemany('INSERT INTO "LLM results" VALUES (?, ?, ?, ?, ?, ?)', rows)
    connection.execute('DELETE FROM "LLM results" WHERE n BETWEEN 100 AND 400')
    connection.commit()
    left = connection.execute('SELECT * FROM "LLM results"').fetchall()
    connection.close()
    return path, left


def tuples(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=str)


def test_a_file_is_read_in_ranges(spark, file, monkeypatch):
    path, rows = file
    monkeypatch.setattr(db, "_LEAST_RANGE", 10)
    for tasks in (1, 5, 60):
        df = db.read_database_file(spark, path, "LLM results", tasks=tasks)
        assert tasks - 2 < df.rdd.getNumPartitions() <= tasks
        assert tuples(df) == sorted(rows, key=str)
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "string", "binary", "string"]


def test_only_the_columns_asked_for(spark, file):
    path, rows = file
    df = db.read_database_file(spark, path, "LLM results", ["n", 'odd "name'])
    assert tuples(df) == sorted(((r[1], r[3]) for r in rows), key=str)


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_conditions(spark, file, pushed):
    path, rows = file
    whole = spark.createDataFrame(rows, db.read_database_file(spark, path, "LLM results").schema)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        for condition in ("n = 5", "n > 900 and share < 240", "n in (1, 2, 450)", "n is null", "question like 'q99%'", "`odd \"name` >= '97'", "length(question) > 8", "n != 3", "`when` = '2024-01-02'"):
            df = db.read_database_file(spark, path, "LLM results")
            want = whole.where(condition).count()
            assert df.where(condition).select("question").count() == want, condition
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_pushed_conditions_reach_the_file(file):
    path, _ = file
    source = db.DatabaseFile({"path": path, "table": "LLM results", "filters": "true"})
    reader = source.reader(source.schema())
    left = list(reader.pushFilters([db.ds.EqualTo(("n",), 5), db.ds.StringContains(("question",), "x"), db.ds.In(("n",), (5, None))]))
    assert len(left) == 2 and reader.conditions == ['CAST("n" AS INTEGER) = ?']
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]


def test_written_files_come_back(spark, tmp_path, items):
    path = str(tmp_path / "out")
    df = items.select("item_id", "question", F.lit(1.5).alias("x"), F.col("correct")).repartition(5)
    db.write_database_files(df.where("item_id % 2 = 0"), path, "t")
    db.write_database_files(df.where("item_id % 2 = 1"), path, "t")
    back = db.read_database_file(spark, path, "t")
    assert tuples(back) == tuples(df) and back.schema == df.schema
    assert len([f for f in os.listdir(path) if f.endswith(".db")]) == 10
    db.write_database_files(df.where("item_id = 4"), path, "t", mode="overwrite")
    assert [r["item_id"] for r in db.read_database_file(spark, path, "t").collect()] == [4]
    db.write_database_files(df.limit(0), path, "t", mode="overwrite")
    assert db.read_database_file(spark, path, "t").collect() == []


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "out")
    db.write_database_files(spark.range(10).select(F.col("id").alias("a")), path, "t")
    torn = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("a"))
    with pytest.raises(Exception):
        db.write_database_files(torn, path, "t")
    assert db.read_database_file(spark, path, "t").count() == 10
    assert not [name for name in os.listdir(path) if name.startswith("_staging")]


def test_what_cannot_be_read_or_written(spark, tmp_path, file):
    with pytest.raises(Exception, match="no table"):
        db.read_database_file(spark, file[0], "other")
    with pytest.raises(Exception, match="in place"):
        db.read_database_file(spark, "s3a://bucket/x.db", "t")
    with pytest.raises(Exception, match="no column type"):
        db.write_database_files(spark.range(3).select(F.array("id").alias("a")), str(tmp_path / "o"), "t")


def test_a_table_without_row_ids(spark, tmp_path):
    path = str(tmp_path / "w.db")
    connection = sqlite3.connect(path)
    connection.execute("CREATE TABLE t (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    connection.executemany("INSERT INTO t VALUES (?, ?)", [(str(i), i) for i in range(50)])
    connection.commit()
    connection.close()
    assert db.read_database_file(spark, path, "t").count() == 50
