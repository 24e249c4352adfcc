"""Runs the registered queries beside their SQL and compares rows."""

from __future__ import annotations

import os
import sys
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, entry, name: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {df.columns} against {columns}"
    want = rows_of(columns, cursor.fetchall())
    if got != want:
        return f"{sum(got.values())} against {sum(want.values())} rows; only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or entry.oracle_sql():
        try:
            print(name, compare(spark, entry, name, sys.argv[1]) or "ok")
        except Exception as e:  # noqa: BLE001 - a report
            print(name, "FAILED", str(e)[:300])
