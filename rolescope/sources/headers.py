"""CSV bound by column name, with a quarantine for records that do not fit their header."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import let
from .files import CSV_OPTIONS
from .records import csv_records
from .tables import stored

#: Different headers among the files of one load; each adds a branch to the plan.
MOST_HEADERS = 64
#: Why a record is turned away: fewer or more fields than its header, or a quote left open.
SHORT, LONG, UNCLOSED = "short", "long", "unclosed"
_CORRUPT = "_corrupt"


class HeaderError(ValueError):
    """A header that repeats a name, lacks a column asked for, or one too many of them."""


@dataclass(frozen=True)
class Load:
    """Rows that fit, and records that do not: file, block, record, reason, text."""

    rows: DataFrame
    rejects: DataFrame
    marked: DataFrame

    def counts(self) -> DataFrame:
        """outcome (loaded or a reason), n_records: in one pass, reasons without a record included."""
        n = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0).cast("long"))
        whole = self.marked.agg(
            n(F.col("_reason").isNull()).alias("loaded"),
            *[n(F.col("_reason") == reason).alias(reason) for reason in (SHORT, LONG, UNCLOSED)],
        )
        return whole.unpivot([], ["loaded", SHORT, LONG, UNCLOSED], "outcome", "n_records")


def header_names(text: str) -> list[str]:
    """The column names of a header record; a byte order mark is dropped."""
    names = next(csv.reader([text.removeprefix("﻿")], strict=False), [])
    if len(set(names)) < len(names):
        raise HeaderError(f"a header repeats a name: {names}")
    return names


def _parsed(text: Column, names: Sequence[str], columns: Sequence[str]) -> Column:
    """A record as a struct of the columns by name, and _corrupt where its fields are not as many as names."""
    schema = StructType([StructField(f"f{i}", StringType()) for i in range(len(names))])
    schema.add(_CORRUPT, StringType())
    options = CSV_OPTIONS | {"multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    options.pop("header")
    place = {name: f"f{i}" for i, name in enumerate(names)}
    null = F.lit(None).cast("string")

    def by_name(fields: Column) -> Column:
        values = [(fields[place[c]] if c in place else null).alias(c) for c in columns]
        return F.struct(*values, fields[_CORRUPT].isNotNull().alias(_CORRUPT))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return let(F.from_csv(text, kinds, options), by_name)


def _reason(text: Column, fields: Column) -> Column:
    """Fields are counted outside quotes."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    commas = F.length(bare) - F.length(F.translate(bare, ",", ""))
    return F.when(bare.contains('"'), UNCLOSED).when(commas + 1 < fields, SHORT).otherwise(LONG)


def read_by_header(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType,
    columns: Sequence[str] | None = None,
    missing: str = "error",
) -> Load:
    """Files with a header each, bound by name: columns may stand in any order and differ by file.

    ``columns`` is a subset to return, all of ``schema`` by default; other columns of a file are
    ignored. A column that a header lacks is an error, or NULL with ``missing="null"``. An empty
    field is NULL. Records with fewer or more fields than their own header, and a record whose
    quote is never closed, are turned away with the reason; no field is lost in silence. Large
    files are read by several tasks (``records.csv_records``). A file with a header only gives
    no rows, and so does one whose first block is blank. The driver sees the distinct headers.
    """
    columns = list(columns or schema.names)
    if unknown := [c for c in columns if c not in schema.names]:
        raise HeaderError(f"not in the schema: {unknown}")
    records = csv_records(spark, paths)
    top = F.min(F.when(F.col("block") == 0, F.col("record")))
    first = records.groupBy("file").agg(F.lit(0).cast("long").alias("block"), top.alias("record"))
    heads = records.join(first, ["file", "block", "record"]).select("file", "block", "record", F.col("text").alias("head"))
    heads = stored(heads, "csv-headers")
    headers = [r.head for r in heads.select("head").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(headers) > MOST_HEADERS:
        raise HeaderError(f"more than {MOST_HEADERS} different headers")
    layouts = {text: header_names(text) for text in headers}
    for names in layouts.values():
        if missing == "error" and (lacking := [c for c in columns if c not in names]):
            raise HeaderError(f"a header lacks {lacking}: {names}")
    heads = heads.select("file", F.col("record").alias("_record"), "head")
    body = records.join(heads, "file").where((F.col("block") > 0) | (F.col("record") != F.col("_record")))
    bound = F.lit(None).cast(StructType([*[StructField(c, StringType()) for c in columns]]).add(_CORRUPT, "boolean"))
    fields = F.lit(0)
    for text, names in layouts.items():
        mine = F.col("head") == text
        bound = F.when(mine, _parsed(F.col("text"), names, columns)).otherwise(bound)
        fields = F.when(mine, len(names)).otherwise(fields)
    # a generator keeps the optimizer from parsing once more for the filter
    own = [F.col(c).alias(f"_{c}") for c in ("file", "block", "record", "text")]
    spread = body.select(*own, fields.alias("_fields"), F.inline(F.array(bound)))
    odd = F.col(_CORRUPT) | (F.regexp_count("_text", F.lit('"')) % 2 == 1)
    marked = spread.withColumn("_reason", F.when(odd, _reason(F.col("_text"), F.col("_fields"))))
    rejects = marked.where(F.col("_reason").isNotNull())
    return Load(
        marked.where(F.col("_reason").isNull()).select(*columns),
        rejects.select(*[F.col(f"_{c}").alias(c) for c in ("file", "block", "record", "reason", "text")]),
        marked,
    )


def save_load(load: Load, target: str, quarantine: str) -> tuple[int, int]:
    """Appends the rows, and the rejects where there are any; returns how many of each.

    Both are counted while the rows are written.
    """
    seen = Observation("load")
    bad = F.col("_reason").isNotNull()
    counted = load.marked.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    counted.where(~bad).select(*load.rows.columns).write.mode("append").parquet(target)
    n, rejected = seen.get["n"], seen.get["bad"]
    if rejected:
        load.rejects.write.mode("append").parquet(quarantine)
    return n - rejected, rejected
