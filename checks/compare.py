"""Compare registered queries with their SQL: `python -m checks.compare <sf_dir> [name ...]`."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES
from mailverdict.session import build_session


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    table = con.sql(sql).to_arrow_table()
    names = sorted(table.column_names)
    return names, Counter(zip(*(table.column(n).to_pylist() for n in names), strict=True))


def spark_rows(spark: SparkSession, sf_dir: str, name: str) -> tuple[list[str], Counter]:
    table = QUERIES[name](spark, sf_dir).toArrow()
    names = sorted(table.column_names)
    return names, Counter(zip(*(table.column(n).to_pylist() for n in names), strict=True))


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or list(QUERIES):
        began = time.time()
        columns, got = spark_rows(spark, sf_dir, name)
        took = time.time() - began
        if name not in ORACLES:
            print(f"{name}: rows only, {got.total()} rows, {took:.1f} s", flush=True)
            continue
        want_columns, want = oracle_rows(sf_dir, ORACLES[name])
        same = columns == want_columns and got == want
        bad += not same
        print(f"{name}: {'ok' if same else 'DIFFERS'}, {got.total()} rows, {took:.1f} s", flush=True)
        if not same:
            print("  columns", columns, want_columns)
            print("  spark only", len(got - want), list((got - want).items())[:2])
            print("  sql only", len(want - got), list((want - got).items())[:2])
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
