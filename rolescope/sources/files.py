"""CSV in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas

# Quotes are doubled inside quoted text, on both sides; blanks around values are data.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_raw_csv(spark: SparkSession, path, schema: StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header and a fixed schema; an empty field is NULL.

    Text may hold line breaks, and Spark then reads each file in one task: deliver large
    tables as many files, and convert them to Parquet once. ``multi_line=False`` splits
    files that are known to have no quoted line breaks.
    """
    options = CSV_OPTIONS | {"multiLine": str(multi_line).lower()}
    return spark.read.schema(schema).options(**options).csv(path)


def read_clean_postings(spark: SparkSession, path) -> DataFrame:
    return read_raw_csv(spark, path, schemas.POSTINGS_FINAL)


def read_clean_skills(spark: SparkSession, path) -> DataFrame:
    return read_raw_csv(spark, path, schemas.SKILLS_FINAL)


def write_csv(df: DataFrame, path: str) -> None:
    """A directory of CSV files with headers, readable by ``read_raw_csv``."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def loaded_rows(df: DataFrame, name: str = "loaded_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def preview(
    df: DataFrame, cols: Sequence[str], n: int, cut: Mapping[str, int] | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """The first n rows with long texts cut; definite only with ``order``."""
    cut = cut or {}
    rows = df.orderBy(*order) if order else df
    return rows.select(
        *[F.left(F.col(c), F.lit(cut[c])).alias(f"{c}_preview") if c in cut else F.col(c) for c in cols]
    ).limit(n)
