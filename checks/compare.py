"""Runs registered queries next to their SQL twins and reports differences.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connection


def canonical(rows, names) -> list[tuple]:
    """Rows with columns in name order, sorted; types count as much as values."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark, connection, folder: str, name: str, query, sql: str) -> str | None:
    df = query(spark, folder)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if repr(mine) == repr(theirs):
        return None
    apart = [(a, b) for a, b in zip(mine, theirs) if repr(a) != repr(b)][:3]
    return f"{len(mine)} rows against {len(theirs)}; first differences: {apart}"


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rolescope")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(folder: str = "/root/testdata/sf0.01", *only: str) -> int:
    from .oracles import ORACLES
    from .queries import QUERIES

    spark, connection, bad = session(), duck(folder), 0
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem = difference(spark, connection, folder, name, query, ORACLES[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(QUERIES)} differ; without SQL twin: {sorted(set(QUERIES) - set(ORACLES))}")
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
