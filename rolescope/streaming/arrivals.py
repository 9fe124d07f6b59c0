"""CSV files as they arrive, bound by header, in batches that are loaded once each.

A ledger names the files of every completed batch. A batch writes its rows and rejects to
folders of its own number and enters the ledger last; a run that was cut short does the same
number again and replaces what it left. Readers go by the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.headers import read_by_header
from ..sources.reload import counted, read_or_empty

_ENTRY = "batch long, file string, n_rows long, n_rejected long"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """batch, file, and the rows and rejects of the file's whole batch."""
    return read_or_empty(spark, f"{folder}/ledger", _ENTRY)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """batch, n_files, n_rows, n_rejected of every completed batch."""
    own = ledger(spark, folder).groupBy("batch", "n_rows", "n_rejected").agg(F.count("*").alias("n_files"))
    return own.select("batch", "n_files", "n_rows", "n_rejected")


def _completed(spark: SparkSession, folder: str, part: str, kinds: StructType) -> DataFrame:
    done = [r.batch for r in ledger(spark, folder).select("batch").distinct().collect()]
    if not done:
        return spark.createDataFrame([], kinds)
    rows = spark.read.option("basePath", f"{folder}/{part}").schema(kinds)
    return rows.parquet(*[f"{folder}/{part}/batch={n}" for n in sorted(done)])


def loaded(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of completed batches, with their batch."""
    return _completed(spark, folder, "rows", StructType([*schema.fields]).add("batch", "long"))


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The records that were turned away, with file, place, reason and batch."""
    kinds = "file string, block long, record long, reason string, text string, batch long"
    return _completed(spark, folder, "rejects", spark.createDataFrame([], kinds).schema)


def load_arrivals(
    spark: SparkSession, source: str, folder: str, schema: StructType, files_per_batch: int = 100, missing: str = "error"
) -> int:
    """Loads the files of ``source`` that the ledger in ``folder`` does not have; returns the batches done.

    The oldest files come first. The driver sees the names of one batch at a time. A header
    that lacks a column stops the run at its batch; the batches before stay loaded.
    """
    done = 0
    while True:
        entered = ledger(spark, folder)
        files = spark.read.format("binaryFile").load(source).select("path", "modificationTime")  # contents are not read
        new = files.join(entered, files["path"] == entered["file"], "left_anti").orderBy("modificationTime", "path")
        paths = [r.path for r in new.limit(files_per_batch).collect()]
        if not paths:
            return done
        number = (entered.agg(F.max("batch")).first()[0] or 0) + 1
        load = read_by_header(spark, paths, schema, missing=missing)
        sizes = {}
        for part, rows in (("rows", load.rows), ("rejects", load.rejects)):
            path = f"{folder}/{part}/batch={number}"
            sizes[part] = counted(rows, lambda d, path=path: d.write.mode("overwrite").parquet(path))
        entry = spark.createDataFrame([(number, p, sizes["rows"], sizes["rejects"]) for p in paths], _ENTRY)
        entry.coalesce(1).write.mode("append").json(f"{folder}/ledger")
        done += 1
