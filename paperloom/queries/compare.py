"""Run queries and their SQL side by side: python -m paperloom.queries.compare [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time
import traceback
from numbers import Number
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from paperloom.queries.registry import QUERIES

TABLES = "pages documents labels benchmark conversations part".split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows in a fixed order, columns by name, missing values alike."""
    frame = frame[sorted(frame.columns)]

    def cell(value: object) -> str:
        if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
            return "<null>"
        return repr(float(value)) if isinstance(value, Number) and not isinstance(value, bool) else str(value)

    return sorted(tuple(cell(value) for value in row) for row in frame.itertuples(index=False))


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments and Path(arguments[0]).is_dir() else "/root/testdata/sf0.01"
    names = [name for name in arguments if name in QUERIES] or list(QUERIES)
    spark = session()
    connection = connect(sf_dir)
    failures = 0
    for name in names:
        started = time.time()
        try:
            found = QUERIES[name].run(spark, sf_dir).toPandas()
            took = time.time() - started
            if QUERIES[name].sql is None:
                print(f"rows  {name}: {len(found)} rows, {took:.2f} s")
                continue
            expected = connection.execute(QUERIES[name].sql).df()
            same = sorted(found.columns) == sorted(expected.columns) and canonical(found) == canonical(expected)
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(found)} / {len(expected)} rows, {took:.2f} s")
            if not same:
                failures += 1
                print("  columns", sorted(found.columns), sorted(expected.columns))
                left, right = canonical(found), canonical(expected)
                for row in [row for row in left if row not in set(right)][:2]:
                    print("  spark", str(row)[:600])
                for row in [row for row in right if row not in set(left)][:2]:
                    print("  sql  ", str(row)[:600])
        except Exception:  # noqa: BLE001 - the run goes on with the next query
            failures += 1
            print(f"FAIL  {name}")
            print("  " + "\n  ".join(traceback.format_exc().splitlines()[-12:])[:2500])
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
