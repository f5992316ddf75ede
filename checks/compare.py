"""Runs queries and their SQL on the same tables and compares the rows.

    python -m checks.compare [--sf DIR] [query ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.queries import QUERIES, SQL


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str:
    started = time.time()
    frame = QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    spark_seconds = time.time() - started
    if name not in SQL:
        return f"rows only  {name}: {sum(got.values())} rows, {spark_seconds:.1f}s"
    started = time.time()
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    sql_seconds = time.time() - started
    times = f"{sum(got.values())} rows, spark {spark_seconds:.1f}s, sql {sql_seconds:.1f}s"
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS  {name}: {sorted(frame.columns)} != {sorted(columns)}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"DIFFERS  {name}: {times}, sql has {sum(want.values())} rows\n  only spark: {extra}\n  only sql: {missing}"
    return f"{'same' if got else 'EMPTY'}  {name}: {times}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(args.sf)
    for name in args.names or list(QUERIES):
        try:
            print(compare(spark, con, name, args.sf), flush=True)
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the others
            print(f"FAILED  {name}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
