"""Tables in database files, read and written by Spark's tasks themselves; no server is involved.

A source is one database file, or a folder of them with a manifest, as written here. Reading plans
ranges of row ids, each a task of its own that opens the file for reading and takes its range; the
wanted columns and, where the session has ``spark.sql.python.filterPushdown.enabled``, simple
conditions go into the file's own query. Writing makes one file per task in a staging folder; the
driver then moves them and names them in a new manifest, so readers see all of a write or none.
Files must lie where all machines see them under one path. One writer at a time.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import quizlake

NAME = "database_file"
_MANIFEST = "_manifest.json"
#: Rows per batch, and least rows worth a task of their own.
_BATCH, _LEAST_RANGE = 10_000, 50_000
_STORED = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}

cloudpickle.register_pickle_by_value(quizlake)


def _local(path: str) -> str:
    """A plain path; files elsewhere cannot be opened in place."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file" and "/" not in scheme:
        raise ValueError(f"database files are opened in place, which {scheme} does not allow: {path}")
    return "/" + rest.lstrip("/") if colon and scheme == "file" else path


def _name(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    if not os.path.isdir(path):
        return [path]
    with open(f"{path}/{_MANIFEST}") as file:
        return [f"{path}/{name}" for name in json.load(file)["files"]]


def _type_of(declared: str) -> T.DataType:
    """Spark's type for a declared column type."""
    declared = declared.upper()
    for marks, kind in ((("INT",), T.LongType()), (("CHAR", "CLOB", "TEXT", "DATE", "TIME"), T.StringType()), (("REAL", "FLOA", "DOUB", "NUM", "DEC"), T.DoubleType()), (("BLOB",), T.BinaryType())):
        if any(mark in declared for mark in marks):
            return kind
    return T.StringType()


@dataclass
class Range(ds.InputPartition):
    """Rows of one file by row id, both ends included; all rows of a table without row ids."""

    file: str
    first: int | None
    last: int | None


class DatabaseFileReader(ds.DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, tasks: int) -> None:
        self.path, self.table, self.schema, self.tasks = path, table, schema, tasks
        self.conditions: list[str] = []
        self.values: list = []

    def _column(self, name: str) -> str:
        """A column as its type; a value of another kind is converted as the database converts it."""
        return f"CAST({_name(name)} AS {_STORED[type(self.schema[name].dataType)]})"

    def partitions(self) -> list[Range]:
        out = []
        files = _files(self.path)
        for file in files:
            connection = _open(file)
            try:
                low, high = connection.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError as problem:
                if "rowid" not in str(problem):
                    raise
                out.append(Range(file, None, None))
                continue
            finally:
                connection.close()
            if low is None:
                continue
            tasks = max(1, min(-(-self.tasks // len(files)), (high - low) // _LEAST_RANGE))
            step = -(-(high - low + 1) // tasks)
            out += [Range(file, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [Range("", None, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        wanted = to_arrow_schema(self.schema)
        conditions, values = list(self.conditions), list(self.values)
        if partition.first is not None:
            conditions.insert(0, "rowid BETWEEN ? AND ?")
            values = [partition.first, partition.last, *values]
        columns = ", ".join(self._column(name) for name in self.schema.names)
        where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
        connection = _open(partition.file)
        try:
            cursor = connection.execute(f"SELECT {columns} FROM {_name(self.table)}{where}", values)
            while rows := cursor.fetchmany(_BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), wanted)], schema=wanted)
        finally:
            connection.close()


class FilteringReader(DatabaseFileReader):
    """A reader that takes conditions; Spark accepts it only where the session lets it."""

    def pushFilters(self, filters: list[ds.Filter]):
        for condition in filters:
            column = ".".join(getattr(condition, "attribute", ()))
            known = column in self.schema.names and not isinstance(self.schema[column].dataType, T.BinaryType)
            if known and type(condition) in _COMPARED:
                self.conditions.append(f"{self._column(column)} {_COMPARED[type(condition)]} ?")
                self.values.append(condition.value)
            elif known and isinstance(condition, ds.In) and None not in condition.value:
                self.conditions.append(f"{self._column(column)} IN ({', '.join('?' * len(condition.value))})")
                self.values += condition.value
            elif known and isinstance(condition, ds.StringStartsWith):
                self.conditions.append(f"substr({self._column(column)}, 1, length(?)) = ?")
                self.values += [condition.value] * 2
            elif known and isinstance(condition, (ds.IsNull, ds.IsNotNull)):
                self.conditions.append(f"{_name(column)} IS {'NOT ' if isinstance(condition, ds.IsNotNull) else ''}NULL")
            else:
                yield condition


@dataclass
class Written(ds.WriterCommitMessage):
    file: str | None


class DatabaseFileWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool) -> None:
        odd = [f.name for f in schema if type(f.dataType) not in _STORED]
        if odd:
            raise ValueError(f"no column type for {odd} in a database file")
        self.path, self.table, self.schema, self.overwrite = path, table, schema, overwrite
        # Made here and not by the tasks: one that outlives an abort must not make it again.
        self.staging = f"{path}/_staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        file, connection = None, None
        columns = ", ".join(f"{_name(f.name)} {_STORED[type(f.dataType)]}" for f in self.schema)
        places = ", ".join("?" * len(self.schema))
        for batch in iterator:
            if not batch.num_rows:
                continue
            if connection is None:
                file = f"{self.staging}/part-{uuid.uuid4().hex}.db"
                connection = sqlite3.connect(file, isolation_level=None)
                # Nobody reads the file before it is committed as a whole.
                connection.execute("PRAGMA journal_mode = OFF")
                connection.execute("PRAGMA synchronous = OFF")
                connection.execute("BEGIN")
                connection.execute(f"CREATE TABLE {_name(self.table)} ({columns})")
            rows = zip(*(column.to_pylist() for column in batch.columns))
            connection.executemany(f"INSERT INTO {_name(self.table)} VALUES ({places})", rows)
        if connection is not None:
            connection.execute("COMMIT")
            connection.close()
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        manifest = f"{self.path}/{_MANIFEST}"
        files = []
        if not self.overwrite and os.path.exists(manifest):
            with open(manifest) as file:
                files = json.load(file)["files"]
        for message in messages:
            if message is not None and message.file:
                name = os.path.basename(message.file)
                os.replace(message.file, f"{self.path}/{name}")
                files.append(name)
        schema = json.loads(self.schema.json())
        with open(f"{manifest}.{uuid.uuid4().hex}", "w") as file:
            json.dump({"files": files, "table": self.table, "schema": schema}, file)
        os.replace(file.name, manifest)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class DatabaseFile(ds.DataSource):
    """Options: ``path``, ``table``, ``columns`` (a JSON list; all by default), ``tasks``, and ``filters``
    (``true`` where the session pushes conditions down)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _place(self) -> tuple[str, str]:
        return _local(self.options["path"]), self.options["table"]

    def schema(self) -> T.StructType:
        path, table = self._place()
        if os.path.isdir(path):
            with open(f"{path}/{_MANIFEST}") as file:
                known = T.StructType.fromJson(json.load(file)["schema"])
        else:
            connection = _open(path)
            try:
                rows = connection.execute(f"PRAGMA table_info({_name(table)})").fetchall()
            finally:
                connection.close()
            if not rows:
                raise ValueError(f"no table {table} in {path}")
            known = T.StructType([T.StructField(row[1], _type_of(row[2])) for row in rows])
        wanted = json.loads(self.options.get("columns", "null"))
        return known if wanted is None else T.StructType([known[name] for name in wanted])

    def reader(self, schema: T.StructType) -> DatabaseFileReader:
        kind = FilteringReader if self.options.get("filters") == "true" else DatabaseFileReader
        return kind(*self._place(), schema, int(self.options.get("tasks", 1)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DatabaseFileWriter:
        return DatabaseFileWriter(*self._place(), schema, overwrite)


def read_database_file(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """A table of a database file or of a folder of them, or just some of its columns; ``tasks`` ranges
    of row ids, by default the session's parallelism."""
    spark.dataSource.register(DatabaseFile)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(NAME).options(table=table, filters=filters, tasks=tasks or spark.sparkContext.defaultParallelism)
    if columns is not None:
        reader = reader.option("columns", json.dumps(columns))
    return reader.load(path)


def write_database_files(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """``df`` as a table in a folder of database files: ``append`` to what is there, or ``overwrite`` it."""
    df.sparkSession.dataSource.register(DatabaseFile)
    df.write.format(NAME).option("table", table).mode(mode).save(path)
