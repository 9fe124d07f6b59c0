"""Columns of a table by their exact names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, for each the one of just that name before one that differs in case."""
    folded = [c.lower() for c in df.columns]
    at = [df.columns.index(name) if name in df.columns else folded.index(name.lower()) for name in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in zip(at, names, strict=True)])


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns numbered, but for the named ones, and the names it had: no name clashes with another."""
    own = {df.columns.index(name): name for name in names}
    return df.toDF(*[own.get(i, f"c{i}") for i in range(len(df.columns))]), df.columns
