"""Run queries beside their SQL and compare all values, whatever the row order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(spark_df, connection, sql: str) -> str | None:
    """None if both have the same columns and rows, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    expected = _sorted(result.fetchall(), names)
    found = _sorted([tuple(r) for r in spark_df.collect()], spark_df.columns)
    if len(found) != len(expected):
        return f"{len(found)} rows against {len(expected)}"
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    return None if not wrong else f"{len(wrong)} of {len(found)} rows, first {wrong[0]} against {wrong[1 - 1][1]}"


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, failed = open_tables(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            outcome = difference(df, connection, sql[name]) if name in sql else f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            outcome = f"ERROR {str(error)[:700]}"
        bad = outcome is not None and not outcome.endswith("no SQL")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - began:.1f}s {outcome or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]))
