"""Measures to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measures_to_rows(
    df: DataFrame,
    by: Sequence[str],
    labels: Mapping[str, str],
    name: str = "measure",
    value: str = "value",
) -> DataFrame:
    """One row per group and measure; ``labels`` selects the measures and names them."""
    chosen = df.select(*by, *[F.col(m).alias(label) for m, label in labels.items()])
    return chosen.unpivot(list(by), list(labels.values()), name, value)
