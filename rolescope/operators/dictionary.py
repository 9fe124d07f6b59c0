"""Work done once per distinct value instead of once per row.

Titles and locations repeat: a population has far fewer of them than adverts, and the rules
that read them are long. Counts start from the distinct values and the rows each stands for;
columns derived from a value are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Rows that a distinct value stands for.
ROWS = "_rows"


def by_value(df: DataFrame, *cols: str) -> DataFrame:
    """The distinct values of the columns, NULL included, with ``_rows``; combined before the shuffle."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(ROWS))


def resolve(df: DataFrame, col: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``derive`` adds to a table of the distinct values of ``col``.

    The derived table is written to the shared folder once, so its size is known: below Spark's
    broadcast threshold it goes to the rows, which then are not shuffled, above it both sides
    are shuffled by the value, where AQE can split a frequent one. NULL is a value.
    """
    derived = derive(df.select(col).distinct())
    added = [c for c in derived.columns if c != col]
    table = stored(derived.select(F.col(col).alias("_value"), *added), "resolved_values")
    joined = df.drop(*added).join(table, F.col(col).eqNullSafe(F.col("_value")), "left")
    return joined.drop("_value")
