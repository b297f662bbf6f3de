"""Samples that follow their data: the rows of lowest hash, kept and merged with what is new.

A sample of the package is the lowest rows by a seeded hash, in all or per letter. The lowest rows of
old and new data together are among the lowest of each, so a store of the lowest ``k`` needs new rows
only: it takes their lowest, merges them with its own and keeps the lowest again. Any sample up to its
size is then what it would be over everything.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quizlake import fixed_values as fv
from quizlake.operators import sampling
from quizlake.sources.commit_log import CommitLog


class SampleStore:
    """The ``k`` lowest rows under ``root``, per letter of the column ``letter`` or, without it, in all."""

    def __init__(self, spark: SparkSession, root: str, k: int, key: str = "item_id", seed: int = fv.SAMPLE_SEED, letter: str | None = "correct") -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._k, self._key, self._seed, self._letter = k, key, seed, letter
        self._log = CommitLog(spark, f"{self.root}/log")
        self._settings = {"k": k, "key": key, "seed": seed, "letter": letter}

    def _lowest(self, df: DataFrame, n: int) -> DataFrame:
        """``n`` rows in all; of a stratified sample as many per letter as its quotas say."""
        if self._letter is None:
            return sampling.sample_uniform(df, n, self._key, self._seed).drop("rank")
        return sampling.sample_stratified(df, n, self._key, self._seed, self._letter).drop("class_rank", "shuffle_key")

    def _size(self) -> int:
        return self._k if self._letter is None else self._k * len(fv.LETTERS)

    def rows(self) -> DataFrame | None:
        """All rows kept, None before the first update."""
        latest = self._log.latest()
        if latest is None:
            return None
        entry = self._log.read(latest)
        if entry["settings"] != self._settings:
            raise ValueError(f"{self.root} was made with {entry['settings']}")
        return self.spark.read.parquet(f"{self.root}/{entry['folder']}")

    def update(self, new: DataFrame) -> None:
        """Take in rows that the store has not seen; of two updates at once the later one merges again."""
        low = None
        while True:
            latest, kept = self._log.latest(), self.rows()
            if low is None:
                path = f"{self.root}/new-{uuid.uuid4().hex}"
                self._lowest(new, self._size()).write.parquet(path)
                low = self.spark.read.parquet(path)
            merged = low if kept is None else self._lowest(kept.unionByName(low), self._size())
            folder = f"rows-{uuid.uuid4().hex}"
            merged.write.parquet(f"{self.root}/{folder}")
            if self._log.put((latest or 0) + 1, {"settings": self._settings, "folder": folder}):
                return

    def sample(self, n: int) -> DataFrame:
        """The sample of ``n`` rows over everything taken in so far."""
        kept = self.rows()
        if kept is None:
            raise ValueError(f"nothing in {self.root}; call update() first")
        most = max(sampling.quotas(n).values()) if self._letter else n
        if most > self._k:
            raise ValueError(f"{most} rows wanted of {self._k} kept")
        return self._lowest(kept, n)
