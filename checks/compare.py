"""Runs registered queries on both engines: ``python -m checks.compare [sf_dir] [query …]``."""

import glob
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.expected import SQL
from checks.queries import QUERIES

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty if both sides agree in columns, types and values, whatever the order of rows."""
    rows = QUERIES[name](spark, sf_dir)
    columns = sorted(rows.columns)
    ours = Counter(tuple(r) for r in rows.select(*columns).collect())
    if name not in SQL:
        return ""
    answer = con.execute(SQL[name])
    names = [c[0] for c in answer.description]
    if sorted(names) != columns:
        return f"columns {columns} / {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(r[i] for i in order) for r in answer.fetchall())
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    kinds = [f"{c}: {t}/{types[c]}" for c, t in rows.dtypes if TYPES.get(t) != types[c]]
    if ours != theirs:
        return f"{sum(ours.values())} / {sum(theirs.values())} rows; ours only {list((ours - theirs).items())[:3]}; " \
            f"theirs only {list((theirs - ours).items())[:3]}"
    return f"types {kinds}" if kinds else ""


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
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
    con = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - start:.1f}s {problem}", flush=True)


if __name__ == "__main__":
    main()
