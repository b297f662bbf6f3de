"""Score sheets that grow with their result files.

Every scored file leaves a row of sums: records, answered, blank, without reference, hits. Sums of files
add up to those of their runs, so a sheet over all files is a small aggregation, and new files cost
their own reading only. A file is known by path, length and time; one that has changed is scored
again and its last sums count, one that is gone counts no more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.operators.scoring import share
from quizlake.session import materialise
from quizlake.sources.commit_log import CommitLog
from quizlake.sources.run_csv import RUN_FILES, RunFiles, file_listing

_SUMS = ("n", "answered", "blank", "no_reference", "hits")
_SCHEMA = "path string, length bigint, time timestamp, gone boolean, run string, " + ", ".join(f"{c} bigint" for c in _SUMS) + ", step int"


class ScoreLog:
    """The sums of the files of ``folder``, kept under ``root``."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        folder: str,
        n_shot: int | Column = 0,
        pattern: str = RUN_FILES,
        record_separator: str | None = None,
    ) -> None:
        self.spark, self.root, self.folder = spark, root.rstrip("/"), folder
        self._n_shot, self._pattern, self._separator = n_shot, pattern, record_separator
        self._log = CommitLog(spark, f"{self.root}/log")

    def _folders(self) -> list[str]:
        latest = self._log.latest()
        return self._log.read(latest)["folders"] if latest else []

    def files(self) -> DataFrame:
        """The last sums of every file that is still there."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.root}/{name}" for name in folders])
        last = rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), "step").alias("last")).select("last.*")
        return last.where("not gone")

    def update(self) -> int:
        """Score the files that are new or have changed, and forget those that are gone; the number of
        files read."""
        there = file_listing(self.spark, self.folder, self._pattern)
        known = self.files()
        same = (F.col("t.path") == F.col("k.path")) & (F.col("t.length") == F.col("k.length")) & (F.col("t.time") == F.col("k.time"))
        fresh = materialise(there.alias("t").join(known.alias("k"), same, "left_anti"), "fresh-files")
        # Names of what is to be read now have to reach the reader.
        names = [r["path"] for r in fresh.select("path").collect()]
        lost = known.join(there, "path", "left_anti").select("path").withColumn("gone", F.lit(True))
        empty = F.lit(0).cast("bigint")
        rows = lost.select("path", empty.alias("length"), F.lit(None).cast("timestamp").alias("time"), "gone", F.lit(None).cast("string").alias("run"), *[empty.alias(c) for c in _SUMS])
        if names:
            sums = RunFiles.scan(self.spark, names, self._pattern, self._separator, base=self.folder).sums(self._n_shot)
            scored = fresh.join(sums, "path", "left").select("path", "length", "time", F.lit(False).alias("gone"), "run", *[F.coalesce(c, empty).alias(c) for c in _SUMS])
            rows = scored.union(rows)
        step = (self._log.latest() or 0) + 1
        name = f"sums-{uuid.uuid4().hex}"
        rows.withColumn("step", F.lit(step)).write.parquet(f"{self.root}/{name}")
        if not self._log.put(step, {"folders": [*self._folders(), name]}):
            raise RuntimeError(f"{self.root} was updated meanwhile; nothing was changed")
        return len(names)

    def sheet(self) -> DataFrame:
        """One row per run: its sums over all files, and the exact-match mean."""
        sums = self.files().where("run is not null").groupBy("run").agg(*[F.sum(c).alias(c) for c in _SUMS])
        return sums.where("n > 0").select("run", *_SUMS[:4], share(F.col("hits"), F.col("n") - F.col("no_reference")).alias("em"))
