"""Run registered queries and their SQL on the same tables and compare the rows.

Usage: python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def differences(left: list[tuple], right: list[tuple]) -> list[str]:
    if len(left) != len(right):
        return [f"{len(left)} rows against {len(right)}"]
    return [f"{a} | {b}" for a, b in zip(left, right) if a != b]


def check(spark, connection, name: str, sf_dir: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    started = time.time()
    found = entry.queries()[name](spark, sf_dir)
    rows = [tuple(row) for row in found.collect()]
    taken = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(rows)} rows in {taken:.1f} s, no SQL"
    started = time.time()
    result = connection.sql(sql)
    columns = result.columns
    expected = result.fetchall()
    sql_taken = time.time() - started
    if sorted(columns) != sorted(found.columns):
        return False, f"columns {sorted(found.columns)} against {sorted(columns)}"
    wrong = differences(canonical(rows, found.columns), canonical(expected, columns))
    text = f"{len(rows)} rows in {taken:.1f} s, SQL {sql_taken:.1f} s"
    return not wrong, text if not wrong else f"{text}; {len(wrong)} differ: {wrong[:2]}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark, connection = session(), connect(folder)
    failed = []
    for name in names:
        try:
            good, text = check(spark, connection, name, folder)
        except Exception as error:  # noqa: BLE001
            good, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(("ok   " if good else "FAIL ") + name, text, flush=True)
        failed += [] if good else [name]
    print("failed:", failed)
