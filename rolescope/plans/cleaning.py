"""Cleaned, classified and located postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.geo import FULL_LOOKUPS, StateLookups, extract_state
from ..functions.rules import UNCATEGORIZED, classify_role
from ..functions.text import last_segment, normalize_title, replace_nbsp, safe_date
from ..operators.dictionary import by_value, resolve
from ..operators.repeats import flag_repeats, keep_first
from ..operators.sample import sample_rows
from ..operators.profile import value_counts
from ..operators.totals import top


def clean_titles(combined: DataFrame) -> DataFrame:
    """Mends the titles and adds their normalised form."""
    return combined.withColumn("job_title", replace_nbsp("job_title")).withColumn(
        "job_title_normalized", normalize_title("job_title")
    )


def with_role(titled: DataFrame, version: str = "final") -> DataFrame:
    return titled.withColumn("role_category", classify_role("job_title_normalized", version))


def with_state(located: DataFrame, lookups: StateLookups = FULL_LOOKUPS, strict: bool = False) -> DataFrame:
    return located.withColumn("location_last_part", last_segment("job_location")).withColumn(
        "state", extract_state("job_location", lookups, strict)
    )


def titles_by_value(combined: DataFrame, version: str = "final") -> DataFrame:
    """Each distinct title once, mended, normalised and with its role, and the ``_rows`` that have it."""
    return with_role(clean_titles(by_value(combined, "job_title")), version)


def locations_by_value(
    combined: DataFrame, lookups: StateLookups = FULL_LOOKUPS, strict: bool = False
) -> DataFrame:
    """Each distinct location once with its state, and the ``_rows`` that have it."""
    return with_state(by_value(combined, "job_location"), lookups, strict)


def locate(combined: DataFrame, lookups: StateLookups = FULL_LOOKUPS, strict: bool = False) -> DataFrame:
    """``with_state`` for tables of many adverts: each location is looked up once and joined back."""
    return resolve(combined, "job_location", lambda values: with_state(values, lookups, strict))


def with_attributes(
    combined: DataFrame,
    version: str = "final",
    lookups: StateLookups = FULL_LOOKUPS,
    strict_state: bool = False,
) -> DataFrame:
    """Mended titles, roles and states: all that is decided row by row."""
    return with_state(with_role(clean_titles(combined), version), lookups, strict_state)


def clean_postings(combined: DataFrame, strict_dates: bool = False, **options) -> DataFrame:
    """The whole cleaning. Reposts are flagged on the titles as they came, before mending."""
    dated = combined.withColumn("first_seen", safe_date("first_seen", strict_dates))
    # The work per row is done before the shuffle by repost group, where rows are spread evenly.
    cleaned = with_attributes(dated.withColumn("_title", F.col("job_title")), **options)
    return flag_repeats(cleaned, ("_title", "company", "job_location")).drop("_title")


def postings_export(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(*schemas.POSTINGS_FINAL.names)


def deduplicated(combined: DataFrame) -> DataFrame:
    """One row per mended title, company and location as written, the lowest key."""
    return keep_first(combined.withColumn("job_title", replace_nbsp("job_title")), normalize=False)


def uncategorized(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("role_category") == UNCATEGORIZED)


def uncategorized_sample(classified: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    return sample_rows(uncategorized(classified), n, seed=seed).select("job_link", "job_title")


def uncategorized_top(classified: DataFrame, k: int = 40, weight: str | None = None) -> DataFrame:
    titles = uncategorized(classified).filter(F.col("job_title_normalized").isNotNull())
    counts = value_counts(titles, "job_title_normalized", weight=weight)
    return top(counts, k, "job_count", "job_title_normalized")
