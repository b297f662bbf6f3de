"""Reading item, result and response tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.operators.joins import fits

_BROADCAST_BYTES = 8 * 1024 * 1024


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table, or just some of its columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_items(df: DataFrame, path: str) -> None:
    """Items laid out by dataset, subset and split.

    Every task writes its own rows, so a split that holds most of them is written by many tasks.
    """
    df.write.partitionBy("dataset", "subset", "split").parquet(path)


def read_split(
    spark: SparkSession, path: str, dataset: str, split: str, subset: str | None = None
) -> DataFrame:
    """Items of one dataset and split, and of one subset if named; other folders are not read."""
    df = spark.read.parquet(path)
    wanted = (F.col("dataset") == dataset) & (F.col("split") == split)
    if subset is not None:
        wanted = wanted & (F.col("subset") == subset)
    return df.where(wanted)


def write_responses(df: DataFrame, path: str, mode: str = "replace") -> None:
    """Responses laid out by run. Writing a run again replaces its rows and leaves other runs alone;
    ``mode="append"`` adds them instead. ``df`` must not be read from ``path``."""
    if mode not in ("replace", "append"):
        raise ValueError("mode must be 'replace' or 'append'")
    writer = df.write.partitionBy("run")
    if mode == "append":
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_colocated(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` as table ``name`` of the session's catalog, its files under ``path``, dealt to ``buckets`` by
    ``key`` and sorted by it.

    Tables with one key and one number of buckets are joined, and grouped by the key, without a
    shuffle. A bucket is read by one task: meant for keys none of which holds a large share of the
    rows; others go through ``joins.attach``.
    """
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def read_runs(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """Responses laid out by run, with the columns of ``runs``, a row per run to read.

    ``runs`` may come from conditions on other columns: where it is small it is broadcast, and Spark
    reads the folders of its runs alone.
    """
    few = F.broadcast(runs) if fits(runs, _BROADCAST_BYTES) else runs
    return spark.read.parquet(path).join(few, "run")


def read_database_table(
    spark: SparkSession, url: str, table: str, driver: str, **options: str
) -> DataFrame:
    """A database table over JDBC, for results kept in a database file.

    The driver jar is the caller's. Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` to read a large table in parallel.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver, **options)
    return reader.load()
