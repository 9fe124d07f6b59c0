"""Reloads that keep the old table readable until the new one is complete and counted.

A reload writes a new version aside, checks its rows against the count taken while writing,
and only then names it in the manifest. Readers go by the manifest, so a load that fails
midway, or whose count is wrong, changes nothing for them. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ENTRY = "number long, version string, n_rows long, written timestamp"


class ReloadError(RuntimeError):
    """The new version is not what was expected; the old one stays current."""


def counted(df: DataFrame, save: Callable[[DataFrame], None]) -> int:
    seen = Observation("reload")
    save(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def _check(written: DataFrame, n: int, expect: int | None, test: Callable[[DataFrame], bool] | None) -> None:
    found = written.count()
    if found != n or (expect is not None and n != expect):
        raise ReloadError(f"{n} rows sent, {found} found, {n if expect is None else expect} expected")
    if test is not None and not test(written):
        raise ReloadError("the new version does not pass its test")


def read_or_empty(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    try:
        return spark.read.schema(kinds).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """number, version, n_rows, written of every completed reload; empty before the first."""
    return read_or_empty(spark, f"{folder}/manifest", _ENTRY)


def _latest(spark: SparkSession, folder: str):
    return history(spark, folder).orderBy(F.desc("number"), F.desc("version")).first()


def reload(
    df: DataFrame,
    folder: str,
    expect: int | None = None,
    test: Callable[[DataFrame], bool] | None = None,
    partition_by: tuple[str, ...] = (),
) -> int:
    """Makes ``df`` the current version of the table in ``folder``; returns its rows.

    ``expect`` is the number of rows it must have, ``test`` a condition that the rows read
    back must meet. If the load fails or does not meet them, the version before stays current.
    """
    spark = df.sparkSession
    last = _latest(spark, folder)
    number = last.number + 1 if last else 1
    version = f"{number:08d}-{uuid4().hex}"
    path = f"{folder}/versions/{version}"
    n = counted(df, lambda d: d.write.partitionBy(*partition_by).parquet(path))
    _check(spark.read.schema(df.schema).parquet(path), n, expect, test)
    entry = spark.range(1).select(
        F.lit(number).cast("long").alias("number"),
        F.lit(version).alias("version"),
        F.lit(n).cast("long").alias("n_rows"),
        F.current_timestamp().alias("written"),
    )
    entry.coalesce(1).write.mode("append").json(f"{folder}/manifest")  # one file: there or not there
    return n


def current(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The rows of the current version, or of the one with that number."""
    if number is None:
        entry = _latest(spark, folder)
    else:
        entry = history(spark, folder).where(F.col("number") == number).first()
    if entry is None:
        raise ReloadError(f"no completed version in {folder}")
    return spark.read.parquet(f"{folder}/versions/{entry.version}")


def reload_table(
    df: DataFrame,
    name: str,
    expect: int | None = None,
    test: Callable[[DataFrame], bool] | None = None,
    keep: int = 2,
    buckets: int | None = None,
    key: str = "job_link",
) -> int:
    """The same for a catalog name: a view that points to the current version's table.

    ``CREATE OR REPLACE VIEW`` is the last step. Of older versions ``keep - 1`` stay; tables of
    failed loads go with the next good one.
    """
    spark = df.sparkSession
    prefix = f"{name}__v"
    schema = name.rpartition(".")[0] or spark.catalog.currentDatabase()
    short = prefix.rpartition(".")[2]

    def versions() -> list[int]:
        names = (t.name.removeprefix(short) for t in spark.catalog.listTables(schema) if t.name.startswith(short))
        return sorted(int(n) for n in names if n.isdigit())

    number = max(versions(), default=0) + 1
    table = f"{prefix}{number}"

    def save(d: DataFrame) -> None:
        writer = d.write.mode("errorifexists").format("parquet")
        (writer.bucketBy(buckets, key).sortBy(key) if buckets else writer).saveAsTable(table)

    try:
        n = counted(df, save)
        _check(spark.table(table), n, expect, test)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        raise
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {table}")
    for old in versions()[:-keep]:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}{old}")
    return n
