"""Result CSVs, one file per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlake.functions import extract
from quizlake.functions.options import options_from_list_text, options_to_list_text
from quizlake.functions.runnames import file_stem, last_segment
from quizlake.operators.joins import attach
from quizlake.schema import RUN_CSV
from quizlake.session import materialise

RUN_FILES = "*_test.csv"


def _csv_options(record_separator: str | None) -> dict[str, str]:
    # Text holds line breaks, so records are found by their quotes and one file is one task. With a
    # separator of its own that never occurs in text, a large file splits like any other.
    if record_separator is None:
        return {"multiLine": "true", "escape": '"'}
    return {"multiLine": "false", "escape": '"', "lineSep": record_separator}


def write_run_csv(
    df: DataFrame,
    path: str,
    record_separator: str | None = None,
    above: list[str] | None = None,
    replace: bool = True,
    few_files: bool = False,
) -> None:
    """Response records as CSV under ``path``, a folder per run, within folders of the columns ``above``.

    Writing a run again replaces its folder and leaves the other runs alone; with ``replace=False``
    the files are added. ``df`` must not be read from ``path``. ``few_files`` brings a run's records
    together first, a large run's in several parts: for many runs out of many tasks.
    """
    rows = df.withColumn("options", options_to_list_text(F.col("options")))
    if few_files:
        rows = rows.hint("rebalance", *(above or []), "run")
    options = {"header": "true", "escape": '"', "quoteAll": "true"}
    if record_separator is not None:
        options["lineSep"] = record_separator
    if replace:
        options["partitionOverwriteMode"] = "dynamic"
    mode = "overwrite" if replace else "append"
    rows.write.mode(mode).options(**options).partitionBy(*(above or []), "run").csv(path)


def _path(column: Column) -> Column:
    """A file's address in one spelling; Spark writes local ones with one slash or with three."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def _decoded(address: Column) -> Column:
    """An address, its escapes undone."""
    return F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))


def _file_name(path: Column) -> Column:
    """File name of an address, its escapes undone."""
    return _decoded(last_segment(path))


def file_listing(spark: SparkSession, folder: str, pattern: str = RUN_FILES) -> DataFrame:
    """Path, length and time of every matching file that holds anything; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("time"))


#: Records without a prompt column, and with one.
_WIDTHS = (4, 5)
_RAW = "_record"


def _width() -> Column:
    """Fields of a record. The parser hands over the text of those that have not all columns, or more;
    its commas outside quotes part the fields."""
    bare = F.regexp_replace(_RAW, r'"[^"]*"', "")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(",")))
    return F.when(F.col(_RAW).isNull(), len(RUN_CSV)).otherwise(commas + 1)


def _is_header(width: Column) -> Column:
    names = RUN_CSV.names
    right = F.array(*[F.col(name) for name in names[:4]]) == F.array(*[F.lit(name) for name in names[:4]])
    last = (width == 4) | ((width == 5) & (F.col(names[4]) == names[4]))
    return F.coalesce(right & last, F.lit(False))


class RunFiles:
    """Result files read once: their records, those set aside with the reason, and a row per file.

    The files are parsed in one scan, each record as it stands, and kept as Parquet in the shared
    folder. Whether a file carries the known header is known when all of it has been read, so
    records meet their file's verdict there, over narrow columns.
    """

    def __init__(self, rows: DataFrame, listing: DataFrame) -> None:
        self._rows = rows
        self._listing = listing

    @classmethod
    def scan(
        cls,
        spark: SparkSession,
        folder: str | list[str],
        pattern: str = RUN_FILES,
        record_separator: str | None = None,
        tree: bool = False,
        base: str | None = None,
    ) -> RunFiles:
        """All matching files of ``folder``, with ``tree`` at any depth; or the files of a list, which lie
        under ``base``."""
        schema = T.StructType([*RUN_CSV.fields, T.StructField(_RAW, T.StringType())])
        found = {"pathGlobFilter": pattern} | ({"recursiveFileLookup": "true"} if tree else {}) | ({"basePath": base} if base else {})
        # Pruning columns would stop the parser from counting fields.
        reader = spark.read.schema(schema).options(
            header="false", mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW, columnPruning="false",
            **found, **_csv_options(record_separator),
        )
        records = reader.csv(folder)
        run = F.col("run").cast("string") if "run" in records.columns else F.lit(None).cast("string")
        rows = records.select(
            _path(F.col("_metadata.file_path")).alias("path"), run.alias("_run"), *RUN_CSV.names, _RAW, _width().alias("_width")
        )
        rows = rows.withColumn("_header", _is_header(F.col("_width")))
        # The text of a record is kept where its fields do not hold it all.
        rows = rows.withColumn(_RAW, F.when(~F.col("_width").isin(*_WIDTHS), F.col(_RAW)))
        # Names alone, as Spark has listed them, empty files too, which its readers pass over; so a file
        # without a record has a row.
        names = spark.createDataFrame([(name,) for name in records.inputFiles()], "path string")
        return cls(materialise(rows, "run-files"), names.select(_path(F.col("path")).alias("path")))

    def _files(self) -> DataFrame:
        return self._rows.groupBy("path").agg(F.max(F.when(F.col("_header"), F.col("_width"))).alias("_known"))

    def _judged(self) -> DataFrame:
        """Records other than headers, with ``fault``: null for those that fit their file's header."""
        data = self._rows.where("not _header")
        fault = (
            F.when(F.col("_known").isNull(), "foreign_header")
            .when(F.col("_width") < F.col("_known"), "short_record")
            .when(F.col("_width") > F.col("_known"), "long_record")
        )
        return attach(data, self._files(), "path").withColumn("fault", fault)

    def records(self) -> DataFrame:
        """Records of files with the known header, with ``path``, ``run`` and options as an array. ``run``
        is the folder's run for files written by ``write_run_csv``, else the file stem."""
        run = F.coalesce("_run", file_stem(_file_name(F.col("path"))))
        fit = self._judged().where("fault is null")
        return fit.select(*RUN_CSV.names, "path", run.alias("run")).withColumn("options", options_from_list_text(F.col("options")))

    def quarantine(self) -> DataFrame:
        """Records set aside: path, file, fault (``foreign_header``, ``short_record``, ``long_record``) and
        the record's text."""
        fields = F.to_csv(F.struct(*RUN_CSV.names), {"escape": '"'})
        set_aside = self._judged().where("fault is not null")
        return set_aside.select("path", _file_name(F.col("path")).alias("file"), "fault", F.coalesce(_RAW, fields).alias("record"))

    def sums(self, n_shot: int | Column = 0) -> DataFrame:
        """Per file with records that fit: path (as in ``file_listing``), run, n, answered, blank,
        no_reference and hits."""
        letter = extract.last_letter_after(F.col("llm_answer"), n_shot)
        graded = self.records().select("path", "run", "correct", F.col("llm_answer").isNull().alias("_blank"), letter.alias("_letter"))
        return graded.groupBy(_decoded(F.col("path")).alias("path"), "run").agg(
            F.count("*").alias("n"),
            F.count("_letter").alias("answered"),
            F.count_if("_blank").alias("blank"),
            F.count_if(F.col("correct").isNull()).alias("no_reference"),
            F.count_if(F.col("_letter") == F.col("correct")).alias("hits"),
        )

    def status(self, n_shot: int | Column = 0) -> DataFrame:
        """One row per file: (path, file, status, n, blank, no_reference, short, long, em), whatever is in
        the file.

        Rows without a reference letter leave the mean, as in ``score_runs``; short and long records
        are counted and leave everything else. ``n_shot`` may be a column over ``path``, where files
        in one folder differ. ``status`` is ``ok``, ``empty_file``, ``no_rows`` or ``bad_columns``;
        only ``ok`` files get a score.
        """
        letter = extract.last_letter_after(F.col("llm_answer"), n_shot)
        fit = F.col("fault").isNull()
        unknown = F.col("correct").isNull()
        graded = self._judged().select(
            "path", "fault", "correct", F.col("llm_answer").isNull().alias("_blank"), F.when(letter == F.col("correct"), 1).otherwise(0).alias("_hit")
        )
        counts = graded.groupBy("path").agg(
            F.count_if(fit).alias("n"),
            F.count_if(fit & F.col("_blank")).alias("blank"),
            F.count_if(fit & unknown).alias("no_reference"),
            F.count_if(F.col("fault") == "short_record").alias("short"),
            F.count_if(F.col("fault") == "long_record").alias("long"),
            F.count_if(F.col("fault") == "foreign_header").alias("_foreign"),
            F.round(F.avg(F.when(fit & ~unknown, F.col("_hit"))), 6).alias("em"),
        )
        files = self._listing.join(self._files().withColumn("_read", F.lit(True)), "path", "left").join(counts, "path", "left")
        status = (
            F.when(F.col("_read").isNull(), "empty_file")
            .when(F.col("_known").isNull(), "bad_columns")
            .when(F.coalesce("n", F.lit(0)) == 0, "no_rows")
            .otherwise("ok")
        )
        # A foreign file's count is that of its records, as far as they can be told.
        n = F.coalesce(F.when(F.col("_known").isNull(), F.col("_foreign")).otherwise(F.col("n")), F.lit(0)).cast("bigint")
        scored = F.col("status") == "ok"
        return files.withColumn("status", status).select(
            "path",
            _file_name(F.col("path")).alias("file"),
            "status",
            n.alias("n"),
            *[F.when(scored, F.col(c)).alias(c) for c in ("blank", "no_reference", "short", "long", "em")],
        )


def read_run_csv(
    spark: SparkSession,
    folder: str,
    pattern: str = RUN_FILES,
    record_separator: str | None = None,
) -> DataFrame:
    """Records of every matching file that has the known header, with ``run`` and options as an array;
    ``RunFiles`` also gives what was set aside."""
    return RunFiles.scan(spark, folder, pattern, record_separator).records().drop("path")


def read_run_csv_tree(
    spark: SparkSession, folder: str, pattern: str = RUN_FILES, record_separator: str | None = None
) -> DataFrame:
    """Records of every matching file at any depth, with ``path``, ``file`` (its stem) and ``folders``,
    the names of the folders between ``folder`` and the file. One scan, whatever the tree."""
    df = RunFiles.scan(spark, folder, pattern, record_separator, tree=True).records().drop("run")
    depth = len([part for part in folder.split("://", 1)[-1].split("/") if part])
    # Parts of the address behind its scheme; a file's last part is its name.
    parts = F.filter(F.split(F.regexp_replace("path", "^[^/]*:/+", "/"), "/"), lambda part: part != "")
    inner = F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth - 1, F.lit(0)))
    inner = F.transform(inner, lambda part: F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))))
    return df.withColumns({"folders": inner, "file": file_stem(_file_name(F.col("path")))})


def run_file_status(
    spark: SparkSession,
    folder: str,
    n_shot: int | Column = 0,
    pattern: str = "*.csv",
    record_separator: str | None = None,
) -> DataFrame:
    """``RunFiles.status`` of the matching files."""
    return RunFiles.scan(spark, folder, pattern, record_separator).status(n_shot)
