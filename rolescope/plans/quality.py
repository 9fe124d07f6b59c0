"""Quality of the postings: gaps, dates, repeats, encodings, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.text import first_segment, is_blank, norm_key
from ..operators import profile as P
from ..operators.repeats import flag_repeats, repeat_audit

COMPLETENESS_VARIABLES = (
    "job_link", "job_title", "role_category", "job_skills", "job_location", "state", "job_level",
)


def location_missing(us_postings: DataFrame) -> DataFrame:
    return P.missing_audit(
        us_postings,
        "job_location",
        ("total_us_ba_jobs", "missing_job_location", "percentage_missing", "distinct_job_locations"),
    )


def date_coverage(postings: DataFrame) -> DataFrame:
    return P.temporal_coverage(
        postings,
        "first_seen",
        (
            "total_job_postings",
            "postings_with_valid_first_seen_date",
            "postings_without_valid_first_seen_date",
            "earliest_first_seen_date",
            "latest_first_seen_date",
            "distinct_collection_dates",
        ),
    )


def posting_repeats(postings: DataFrame) -> DataFrame:
    return repeat_audit(
        postings,
        names=(
            "total_job_postings",
            "distinct_title_company_location_combinations",
            "repeated_combinations",
            "jobs_in_repeated_combinations",
            "potential_excess_records",
            "percentage_jobs_in_repeated_combinations",
        ),
    )


def city_agreement(postings: DataFrame) -> DataFrame:
    """Whether the advertised city is the one the advert was found under."""
    return P.agreement_audit(
        postings,
        norm_key("search_city"),
        norm_key(first_segment("job_location")),
        is_blank("search_city"),
        is_blank("job_location"),
        (
            "total_job_postings",
            "missing_search_city",
            "missing_job_location",
            "matching_city",
            "nonmatching_city",
            "percentage_nonmatching",
        ),
    )


def completeness_table(cleaned: DataFrame) -> DataFrame:
    """Populated share per variable; a state outside the country is not a state."""
    return P.completeness(cleaned, COMPLETENESS_VARIABLES, {"state": [L.NON_US]})


def checkpoint_checks(combined: DataFrame) -> dict[str, DataFrame]:
    """The checks made on the population before it is cleaned."""
    return {
        "duplicate_keys": P.duplicate_key_audit(combined),
        "likely_reposts": flag_repeats(combined).agg(
            P.count_where(F.col("is_likely_repost")).alias("likely_reposts")
        ),
        "location": P.missing_audit(combined, "job_location", null_only=True),
        "encoding": P.encoding_audit(combined, "job_title"),
        "dates": P.temporal_coverage(combined, "first_seen"),
        "levels": P.value_counts(combined, "job_level"),
    }
