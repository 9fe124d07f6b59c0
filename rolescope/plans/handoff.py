"""One row per advert of the population, with its skills and description."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schemas
from ..operators.keys import KEY, enrich
from ..operators.skew import ROWS, hot_keys
from .cohort import STANDARD, CohortSpec, cohort_postings


def handoff_table(
    postings: DataFrame,
    skills: DataFrame,
    summaries: DataFrame,
    spec: CohortSpec = STANDARD,
    keys: DataFrame | None = None,
    split_hot: bool = False,
    rows: int = ROWS,
) -> DataFrame:
    """Adverts without skills or description stay; a repeated key there repeats the row.

    Keys are meant to be unique, and then the joins share one partitioning. ``split_hot`` looks
    for keys of more than ``rows`` rows first, in one pass over the keys of each table, and
    splits them.
    """
    base = cohort_postings(postings, skills, spec, keys=keys)
    for table in (skills, summaries):
        hot = hot_keys(postings, table, KEY, rows) if split_hot else None
        base = enrich(base, table, within=keys, hot=hot)
    return base.select(*schemas.HANDOFF.names)
