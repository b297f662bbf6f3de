"""Compare named queries with their SQL on the same Parquet files."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\x00null"
    if isinstance(value, float):
        return f"{value:.6f}"
    return value if isinstance(value, str) else repr(value)


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = sorted(tuple(_cell(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], cells


def compare(spark, con, name: str, plan, sql: str | None, folder: str) -> tuple[bool, str]:
    started = time.time()
    df = plan(spark, folder)
    mine = sorted_rows(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return True, f"{len(mine[1])} rows, no SQL, {took:.2f}s"
    cursor = con.execute(sql)
    theirs = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if mine == theirs:
        return True, f"{len(mine[1])} rows, {took:.2f}s"
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} != {theirs[0]}"
    wrong = [pair for pair in zip(mine[1], theirs[1]) if pair[0] != pair[1]][:2]
    return False, f"{len(mine[1])} rows against {len(theirs[1])}; first differences {wrong}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from quizlake.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connection(folder), oracle_sql()
    failed = []
    for name, plan in queries().items():
        if wanted and not any(part in name for part in wanted):
            continue
        try:
            good, note = compare(spark, con, name, plan, sql.get(name), folder)
        except Exception as problem:  # noqa: BLE001
            good, note = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        print("ok  " if good else "FAIL", name, note, flush=True)
        if not good:
            failed.append(name)
    print("failed:", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
