"""Schemas of the input and output tables. Raw columns are all text and all nullable."""

from pyspark.sql.types import BooleanType, DateType, StringType, StructField, StructType


def _text(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


POSTINGS = _text(
    "job_link", "last_processed_time", "got_summary", "got_ner", "is_being_worked", "job_title", "company",
    "job_location", "first_seen", "search_city", "search_country", "search_position", "job_level", "job_type",
)
SKILLS = _text("job_link", "job_skills")
SUMMARIES = _text("job_link", "job_summary")
HANDOFF = _text(
    "job_link", "job_title", "company", "job_location", "search_country", "first_seen", "job_skills",
    "job_summary",
)
POSTINGS_FINAL = StructType(
    _text(
        "job_link", "job_title", "job_title_normalized", "role_category", "company", "job_location", "state"
    ).fields
    + [StructField("first_seen", DateType())]
    + _text("job_level", "job_type").fields
    + [StructField("is_likely_repost", BooleanType())]
)
SKILLS_FINAL = _text("job_link", "job_skills", "job_skills_normalized")

# Columns the cleaning job reads.
CLEANING_COLUMNS = (
    "job_link", "job_title", "company", "job_location", "first_seen", "job_level", "job_type", "search_country",
)
