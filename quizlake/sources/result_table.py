"""Result tables on shared storage: create if absent, append, resume, replace.

A table is a folder with one Parquet folder per write and a log whose entries name the folders of
each version. A write first puts its rows into a folder of its own and then commits by adding the
next entry, which only one writer can: whoever finds it taken looks at what came between and tries
again on top of it, or gives up. Readers see whole versions; a crash before the commit changes
nothing, and a plan made on an old version stays valid.

What may come between: an append goes on top of anything. A replacement keeps rows appended since
the version it was made from, and fails if that version was replaced meanwhile. Adding what is
missing fails if anything was written meanwhile. ``update`` and ``seed`` then work out their rows anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.schema import results_schema
from quizlake.sources.commit_log import CommitLog


class VersionConflict(RuntimeError):
    """The table has changed in a way that what was to be committed does not take into account."""


class ResultTable:
    """A result table of kind ``mcq`` or ``numeric`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "mcq") -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = results_schema(kind)
        self._log = CommitLog(spark, f"{self.root}/log")
        self._seen: int | None = None

    def version(self) -> int | None:
        """Current version, None before the table is created."""
        return self._log.latest()

    def _current(self) -> int:
        version = self.version()
        if version is None:
            raise ValueError(f"no table at {self.root}; call create() first")
        return version

    def history(self) -> list[tuple[int, str]]:
        """Version and operation of every commit so far."""
        return [(v, self._log.read(v)["operation"]) for v in range(1, (self.version() or 0) + 1)]

    def _conform(self, df: DataFrame) -> DataFrame:
        """The table's columns; what ``df`` does not know of a reply's making is null."""
        optional = {"error", "attempts"} - set(df.columns)
        return df.select(
            *[(F.lit(None) if f.name in optional else F.col(f.name)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        )

    def _written(self, df: DataFrame) -> str:
        """Rows in a folder that no version names yet."""
        name = f"data-{uuid.uuid4().hex}"
        self._conform(df).write.parquet(f"{self.root}/{name}")
        return name

    def _commit(self, operation: str, base: int, name: str) -> None:
        """Make ``name`` part of the next version, whatever number that gets in the end."""
        while True:
            last = self._current()
            folders = self._log.read(last)["folders"]
            between = [self._log.read(v)["operation"] for v in range(base + 1, last + 1)]
            if operation == "replace":
                if "replace" in between:
                    raise VersionConflict(f"version {base} of {self.root} was replaced meanwhile")
                started = self._log.read(base)["folders"]
                folders = [name] + [f for f in folders if f not in started]
            elif operation == "seed" and between:
                raise VersionConflict(f"{self.root} was written to meanwhile")
            else:
                folders = [*folders, name]
            kind = "replace" if operation == "replace" else "append"
            if self._log.put(last + 1, {"operation": kind, "folders": folders}):
                return

    def create(self) -> ResultTable:
        """Make the table unless it is there."""
        if self.version() is None:
            self._log.put(1, {"operation": "create", "folders": []})
        return self

    def read(self, version: int | None = None) -> DataFrame:
        """The current or an earlier version, with its declared schema."""
        self._seen = self._current() if version is None else version
        folders = [f"{self.root}/{name}" for name in self._log.read(self._seen)["folders"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def append(self, df: DataFrame) -> DataFrame:
        """Add rows; gives them back as they were written."""
        self._current()
        name = self._written(df)
        self._commit("append", 0, name)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}")

    def replace(self, df: DataFrame, base: int | None = None) -> None:
        """Put ``df`` in the place of the version it was made from: ``base``, or the one that this
        object read last. Rows appended since are kept beside it; if that version has been replaced
        since, ``VersionConflict`` is raised and nothing changes."""
        base = base or self._seen or self._current()
        self._commit("replace", base, self._written(df))

    def _retried(self, operation: str, change: Callable[[DataFrame], DataFrame], attempts: int) -> None:
        for left in reversed(range(attempts)):
            rows = change(self.read())
            base = self._seen
            try:
                return self._commit(operation, base, self._written(rows))
            except VersionConflict:
                if not left:
                    raise

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 3) -> None:
        """Replace the table by ``change`` of it, worked out again if it was replaced meanwhile."""
        self._retried("replace", change, attempts)

    def seed(self, items: DataFrame, key: str = "item_id", attempts: int = 3) -> None:
        """Add the items that are not in the table yet; a second call adds nothing, and of two at
        the same time the later one looks again."""
        self._retried("seed", lambda rows: items.join(rows.select(key).distinct(), key, "left_anti"), attempts)

    def compact(self, key: str = "item_id") -> None:
        """Drop pending rows whose item has been answered since, as a new version of one folder."""

        def still(rows: DataFrame) -> DataFrame:
            answered = rows.where(F.col("status") != "pending")
            waiting = rows.where(F.col("status") == "pending")
            return answered.unionByName(waiting.join(answered.select(key).distinct(), key, "left_anti"))

        self.update(still)


def create_catalog_table(spark: SparkSession, name: str, kind: str = "mcq") -> None:
    """The same table declared in the session catalog."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results_schema(kind))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
