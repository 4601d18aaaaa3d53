"""Run queries beside their SQL: ``python -m checks.compare [sf folder] [query ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _canonical(rows: pd.DataFrame) -> list[tuple]:
    rows = rows[sorted(rows.columns)]
    cells = [[None if pd.isna(v) else v for v in rows[c].tolist()] for c in rows.columns]
    return sorted(zip(*cells, strict=True), key=repr) if cells else []


def differences(result: DataFrame, sql: str, connection: duckdb.DuckDBPyConnection) -> str | None:
    """None where both sides agree in columns, types, rows and values."""
    mine = result.toArrow()
    theirs = connection.sql(sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(mine.column_names)} / {sorted(theirs.column_names)}"
    kinds = {c: (str(mine.schema.field(c).type), str(theirs.schema.field(c).type)) for c in mine.column_names}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if odd:
        return f"types {odd}"
    if mine.num_rows != theirs.num_rows:
        return f"rows {mine.num_rows} / {theirs.num_rows}"
    left = _canonical(mine.to_pandas(integer_object_nulls=True, timestamp_as_object=True))
    right = _canonical(theirs.to_pandas(integer_object_nulls=True, timestamp_as_object=True))
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(sf_dir: str, names: list[str]) -> int:
    from tickwright.session import local_session

    spark, connection, failed = local_session(), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = differences(QUERIES[name](spark, sf_dir), ORACLE[name], connection)
        except Exception as error:  # a failing query is a finding, the next one still runs
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    raise SystemExit(main(folder, sys.argv[2:]) > 0)
