"""A log of numbered entries on shared storage, each written once.

An entry is a small JSON file. It is written aside in full and then renamed to its number without
overwriting, so of two writers that try for one number one succeeds, and nobody reads half an entry.
Files go through Hadoop's file systems, so the log can be wherever Spark can write. The rename must
be atomic there: it is on HDFS and the like, nearly so on a local disk, and on object stores only with a
committer that sees to it.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """Entries under ``folder``, numbered from 1."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._folder = folder.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    def latest(self) -> int | None:
        """Number of the last entry, None before the first."""
        if not self._fs.exists(self._path("")):
            return None
        names = [status.getPath().getName() for status in self._fs.listStatus(self._path(""))]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=None)

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, number: int, entry: dict) -> bool:
        """Write an entry if there is none of that number; whether it was written."""
        aside = self._path(f"_{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").makeQualified(self._fs).toUri(), self._conf)
        plain = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(aside, self._path(f"{number:012d}.json"), plain)
        except Py4JJavaError as problem:
            if "FileAlreadyExistsException" not in str(problem.java_exception):
                raise
            self._fs.delete(aside, False)
            return False
        return True
