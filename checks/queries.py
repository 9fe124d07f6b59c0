"""The registered queries: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType

from rolescope import schemas
from rolescope.functions import lookups as L
from rolescope.functions import text as X
from rolescope.functions.geo import DRAFT_LOOKUPS
from rolescope.functions.numbers import pct_even
from rolescope.operators import keys as K
from rolescope.operators import profile as P
from rolescope.operators import repeats as R
from rolescope.operators import sample as S
from rolescope.operators import tokens as T
from rolescope.operators.dictionary import ROWS
from rolescope.operators.reshape import measures_to_rows
from rolescope.operators.totals import rows_of, top
from rolescope.plans import (
    cleaning, cohort, discovery, geography, handoff, quality, sensitivity, sharing, skills,
)
from rolescope.session import prepare
from rolescope.sources.files import (
    loaded_rows, preview, read_clean_postings, read_clean_skills, write_csv,
)
from rolescope.sources.tables import session_table, shared_path
from rolescope.streaming.load import load_new_files, stream_raw_csv

from .adverts import Adverts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def portable(df: DataFrame) -> DataFrame:
    """Types any comparison tool reads alike: decimals as doubles, dates as text, integers as bigint."""
    kinds = {DecimalType: "double", DateType: "string", IntegerType: "bigint"}
    return df.select(
        *[
            F.col(f.name).cast(kinds[type(f.dataType)]).alias(f.name) if type(f.dataType) in kinds else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def on_adverts(build: Callable[[Adverts], DataFrame]) -> Callable[[Adverts], DataFrame]:
    """Registers a query over the advert tables under the name of the function."""
    QUERIES[build.__name__] = lambda spark, folder: portable(build(Adverts(prepare(spark), folder)))
    return build


def on_tables(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
    """Registers a query over the test tables themselves."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return portable(build(lambda name: spark.read.parquet(f"{folder}/{name}.parquet")))

    QUERIES[build.__name__] = run
    return build


def us(a: Adverts) -> DataFrame:
    return cohort.cohort_postings(a.postings, a.skills)


def combined(a: Adverts) -> DataFrame:
    return cohort.cohort_with_skills(a.postings, a.skills)


def clean_rows(a: Adverts) -> DataFrame:
    return cohort.cohort_postings(a.postings, a.skills, cohort.CLEANING)


def skill_lists(a: Adverts) -> DataFrame:
    return cohort.cohort_skill_lists(a.postings, a.skills)


def roles(a: Adverts) -> DataFrame:
    return cleaning.with_role(titled(a))


def titled(a: Adverts) -> DataFrame:
    return cleaning.clean_titles(clean_rows(a))


def located(a: Adverts, **options) -> DataFrame:
    """A row per location, with the adverts it stands for."""
    return cleaning.locations_by_value(clean_rows(a), **options)


# --- size and coverage ----------------------------------------------------------------


@on_adverts
def table_profile(a):
    return P.table_profile({"job_postings": a.postings, "job_skills": a.skills, "job_summary": a.summaries})


@on_adverts
def coverage_matrix(a):
    return P.coverage_matrix(a.postings, {"skills": a.skills, "summary": a.summaries})


@on_adverts
def load_count(a):
    return loaded_rows(a.postings)


@on_adverts
def summary_preview(a):
    return preview(a.summaries, ["job_link", "job_summary"], 10, {"job_summary": 500}, ["job_link"])


# --- rule discovery -------------------------------------------------------------------


@on_adverts
def term_preview(a):
    return discovery.term_preview(a.skills)


@on_adverts
def term_counts(a):
    return discovery.topic_term_counts(a.skills)


@on_adverts
def compare_definitions(a):
    return discovery.definition_counts(a.skills)


@on_adverts
def broad_only_terms(a):
    return discovery.broad_only_terms(a.skills)


@on_adverts
def overlap_audit(a):
    return discovery.title_overlap(a.postings, a.skills)


@on_adverts
def missed_titles(a):
    return discovery.missed_titles(a.postings, a.skills)


@on_adverts
def wide_pattern_titles(a):
    return discovery.wide_pattern_titles(a.postings, a.skills)


@on_adverts
def family_counts(a):
    return discovery.family_counts(a.postings, a.skills)


@on_adverts
def family_sample(a):
    return discovery.family_sample(a.postings, a.skills, a.summaries)


@on_adverts
def evidence_by_family(a):
    return discovery.evidence_by_family(a.postings, a.skills, a.summaries)


@on_adverts
def acronym_count(a):
    return discovery.acronym_count(a.postings, a.skills)


@on_adverts
def acronym_titles(a):
    return discovery.acronym_titles(a.postings, a.skills)


@on_adverts
def acronym_evidence(a):
    return discovery.acronym_evidence(a.postings, a.skills, a.summaries)


# --- population -----------------------------------------------------------------------


@on_adverts
def cohort_size(a):
    return loaded_rows(cohort.build_cohort(a.postings, a.skills), "refined_ba_population")


@on_adverts
def cohort_keys(a):
    return cohort.build_cohort(a.postings, a.skills)


@on_adverts
def country_distribution(a):
    rows = cohort.cohort_postings(a.postings, a.skills, everywhere=True)
    shares = P.distribution(rows, "search_country", share="percentage_of_refined_ba_jobs")
    return shares.orderBy(F.desc("job_count"), "search_country")


@on_adverts
def us_cohort(a):
    return cohort.cohort_in_country(a.postings, a.skills)


@on_adverts
def us_cohort_size(a):
    return loaded_rows(us(a), "refined_us_ba_population")


@on_adverts
def cleaning_cohort_overlap(a):
    """Set algebra on the keys of the skill rule and of the title rule."""
    marks = cohort.cohort_marks(a.postings, a.skills, cohort.CLEANING)
    skill, title, family = (marks.has(x) for x in (cohort.BY_SKILL, cohort.BY_TITLE, cohort.BY_FAMILY))
    return marks.counts(
        {
            "skill rule": skill,
            "title rule": title,
            "already captured": title & skill,
            "missed by skill rule": title & ~skill,
            "family, new": family & ~(skill | title),
            "refined population": skill | title | family,
        }
    )


# --- quality --------------------------------------------------------------------------


@on_adverts
def location_missing(a):
    return quality.location_missing(us(a))


@on_adverts
def temporal_coverage(a):
    return quality.date_coverage(a.postings)


def _us_distribution(a: Adverts, dim: str) -> DataFrame:
    shares = P.distribution(us(a), dim, share="percentage_of_us_ba_jobs")
    return shares.orderBy(F.desc("job_count"), dim)


@on_adverts
def type_distribution(a):
    return _us_distribution(a, "job_type")


@on_adverts
def level_distribution(a):
    return _us_distribution(a, "job_level")


@on_adverts
def employer_top(a):
    return P.top_with_groups(us(a), "company", 30, share="percentage_of_us_ba_jobs", groups="distinct_companies")


@on_adverts
def skill_top_raw(a):
    return skills.top_raw_skills(us(a), a.skills)


@on_adverts
def title_fragmentation(a):
    return P.fragmentation(
        us(a),
        F.trim("job_title"),
        (
            "total_us_ba_jobs",
            "distinct_job_titles",
            "titles_occurring_once",
            "titles_occurring_more_than_once",
            "jobs_with_one_off_titles",
            "percentage_of_titles_occurring_once",
        ),
    )


@on_adverts
def title_top(a):
    shares = P.distribution(us(a), F.trim("job_title"), "job_title", share="percentage_of_us_ba_jobs")
    return top(shares, 30, "job_count", "job_title")


@on_adverts
def repeat_audit(a):
    return quality.posting_repeats(a.postings)


@on_adverts
def city_agreement(a):
    return quality.city_agreement(a.postings)


@on_adverts
def checkpoint_duplicates(a):
    return quality.checkpoint_checks(combined(a))["duplicate_keys"]


@on_adverts
def encoding_audit(a):
    return quality.checkpoint_checks(combined(a))["encoding"]


@on_adverts
def encoding_after_fix(a):
    return P.encoding_audit(titled(a), "job_title", {"nbsp_count": X.NBSP})


@on_adverts
def repost_count(a):
    return quality.checkpoint_checks(combined(a))["likely_reposts"]


@on_adverts
def level_values(a):
    return quality.checkpoint_checks(combined(a))["levels"]


@on_adverts
def completeness(a):
    return quality.completeness_table(cleaning.with_attributes(combined(a)))


# --- repeats and sensitivity ----------------------------------------------------------


@on_adverts
def repost_flags(a):
    return R.flag_repeats(us(a)).select("job_link", "is_likely_repost")


@on_adverts
def sensitivity_keys(a):
    return sensitivity.sensitivity_population(us(a)).select("job_link")


@on_adverts
def sensitivity_counts(a):
    return sensitivity.sensitivity_counts(us(a))


@on_adverts
def sensitivity_as_written(a):
    """Removal on the titles, companies and locations as written."""
    rows = clean_rows(a)
    counted = P.removal_summary(rows, cleaning.deduplicated(rows))
    return counted.withColumn("excluded_pct", pct_even(F.col("removed"), F.col("before"), 2)).drop(
        "percentage_removed"
    )


@on_adverts
def sensitivity_top_titles(a):
    return sensitivity.compare_top_titles(us(a))


@on_adverts
def sensitivity_top_skills(a):
    return sensitivity.compare_top_skills(us(a), a.skills)


@on_adverts
def sensitivity_top_locations(a):
    return sensitivity.compare_top_locations(us(a))


# --- cleaning and classification ------------------------------------------------------


@on_adverts
def handoff_table(a):
    return handoff.handoff_table(a.postings, a.skills, a.summaries)


@on_adverts
def handoff_from_saved_keys(a):
    """The same table from a population written to the shared folder first."""
    keys = session_table(cohort.cohort_in_country(a.postings, a.skills), "us_cohort_keys")
    return handoff.handoff_table(a.postings, a.skills, a.summaries, keys=keys)


@on_adverts
def title_normalized(a):
    return titled(a).select("job_link", "job_title", "job_title_normalized")


@on_adverts
def normalized_title_variety(a):
    return P.distinct_counts(
        titled(a), {"distinct_titles": "job_title", "distinct_normalized": "job_title_normalized"}
    )


def _roles(a: Adverts, version: str) -> DataFrame:
    classified = cleaning.titles_by_value(clean_rows(a), version)
    shares = P.rounded_distribution(classified, "role_category", "job_count", weight=ROWS)
    return shares.orderBy(F.desc("job_count"), "role_category")


@on_adverts
def role_v1(a):
    return _roles(a, "v1")


@on_adverts
def role_v2(a):
    return _roles(a, "v2")


@on_adverts
def role_final(a):
    return _roles(a, "final")


@on_adverts
def role_all_postings(a):
    """The final roles over every advert, in and out of the population."""
    return P.value_counts(cleaning.titles_by_value(a.postings), "role_category", weight=ROWS)


@on_adverts
def uncategorized_sample(a):
    return cleaning.uncategorized_sample(cleaning.with_role(titled(a), "v1"))


@on_adverts
def uncategorized_top(a):
    return cleaning.uncategorized_top(cleaning.titles_by_value(clean_rows(a), "v2"), weight=ROWS)


@on_adverts
def pattern_counts(a):
    leftovers = cleaning.uncategorized(cleaning.titles_by_value(clean_rows(a), "v2"))
    return P.pattern_counts(leftovers, "job_title_normalized", L.LEFTOVER_PATTERNS, weight=ROWS)


@on_adverts
def manager_abbreviation(a):
    return P.pattern_counts(titled(a), "job_title_normalized", {"mgr": r"\bmgr\b"})


@on_adverts
def postings_export(a):
    return cleaning.postings_export(cleaning.clean_postings(clean_rows(a)))


# --- skills ---------------------------------------------------------------------------


@on_adverts
def skills_exploded(a):
    return skills.explode_summary(combined(a))


@on_adverts
def skills_folded_top(a):
    return skills.top_skills(skills.exploded(skill_lists(a)), clean_rows(a))


@on_adverts
def skills_canonical_top(a):
    return skills.top_skills(skills.skill_mart(skill_lists(a)), clean_rows(a))


@on_adverts
def skills_export(a):
    return skills.skill_mart(skill_lists(a))


@on_adverts
def skill_share(a):
    return sharing.skill_shares(roles(a), skills.skill_mart(skill_lists(a)))


@on_adverts
def skill_share_unpivot(a):
    return sharing.skill_share_view(roles(a), skills.skill_mart(skill_lists(a)))


@on_adverts
def role_groups(a):
    return sharing.role_groups(roles(a))


# --- geography ------------------------------------------------------------------------


@on_adverts
def location_last_part(a):
    return geography.location_formats(clean_rows(a))


@on_adverts
def location_variety(a):
    return geography.location_variety(clean_rows(a))


@on_adverts
def state_extract(a):
    return cleaning.locate(clean_rows(a)).select("job_link", "job_location", "location_last_part", "state")


@on_adverts
def state_extract_strict(a):
    return cleaning.locate(clean_rows(a), strict=True).select("job_link", "state")


@on_adverts
def state_resolution_draft(a):
    return geography.state_resolution(located(a, lookups=DRAFT_LOOKUPS), ROWS)


@on_adverts
def state_resolution(a):
    return geography.state_resolution(located(a), ROWS)


@on_adverts
def unresolved_locations(a):
    return geography.unresolved_locations(located(a), weight=ROWS)


@on_adverts
def state_top(a):
    return geography.state_top(located(a), weight=ROWS)


@on_adverts
def state_totals(a):
    return geography.state_totals(located(a), ROWS)


# --- files ----------------------------------------------------------------------------


@on_adverts
def postings_csv_round_trip(a):
    """The typed reader over the postings export."""
    path = shared_path(a.spark, "postings_csv")
    write_csv(cleaning.postings_export(cleaning.clean_postings(clean_rows(a))), path)
    return read_clean_postings(a.spark, path)


@on_adverts
def skills_csv_round_trip(a):
    path = shared_path(a.spark, "skills_csv")
    write_csv(skills.skill_mart(skill_lists(a)), path)
    return read_clean_skills(a.spark, path)


@on_adverts
def summaries_streamed(a):
    """Descriptions written as CSV, line breaks and all, and loaded by the stream in two goes."""
    source, target, progress = (shared_path(a.spark, f"summaries_{part}") for part in ("csv", "loaded", "progress"))
    write_csv(a.summaries, source)
    for _ in range(2):  # the second finds nothing new
        rows = stream_raw_csv(a.spark, source, schemas.SUMMARIES)
        load_new_files(rows, target, progress).awaitTermination()
    return a.spark.read.parquet(target).select("job_link", F.md5("job_summary").alias("summary_md5"))


# --- the same operators on the test tables themselves ---------------------------------


@on_tables
def document_profile(t):
    return P.table_profile({"documents": t("documents"), "labels": t("labels")}, "doc_id")


@on_tables
def document_coverage(t):
    labels = t("labels")
    good = labels.filter(F.col("quality") == 1)
    return P.coverage_matrix(t("documents"), {"label": labels, "good_label": good}, "doc_id", "documents")


@on_tables
def document_terms(t):
    """Comma-separated pieces of whole texts, most widespread first."""
    tokens = T.explode_list(t("documents"), "text", ["doc_id"])
    return top(T.term_counts(tokens, key="doc_id", n="doc_count"), 50, "doc_count", "skill_term")


@on_tables
def document_definitions(t):
    tokens = T.explode_list(t("documents"), "text", ["doc_id"])
    tests = {"the": lambda x: x.contains("the"), "la": lambda x: x == "la", "data": lambda x: x.contains("data")}
    return T.compare_definitions(tokens, tests, key="doc_id", n="doc_count")


@on_tables
def document_repeats(t):
    return R.repeat_audit(t("documents"), ["text"], normalize=False, digest=True)


@on_tables
def document_repeat_flags(t):
    return R.flag_repeats(t("documents"), ["text"], digest=True, name="is_copy").select("doc_id", "is_copy")


@on_tables
def document_first_copies(t):
    rows = t("documents").select("doc_id", "text", "lang")
    return R.keep_first(rows, ["text"], ["doc_id"], digest=True).select("doc_id", "lang")


@on_tables
def document_phrase_rate(t):
    flagged = t("documents").select("lang", X.has_any_phrase(["text"], ["version", "license", "data"]).alias("hit"))
    return P.rate(flagged, "hit", "lang")


@on_tables
def document_sample(t):
    drawn = S.sample_per_group(t("documents"), "lang", 15, "doc_id", seed=7)
    return drawn.select("lang", "sample_number", "doc_id", X.text_preview("text", 700).alias("text_preview"))


@on_tables
def document_sources(t):
    return P.distribution(t("documents"), "source", n="doc_count")


@on_tables
def label_overlap(t):
    return K.overlap_audit(t("documents"), t("labels"), "doc_id")


@on_tables
def page_patterns(t):
    return P.pattern_counts(
        t("pages"), "html", {"title": r"<title>", "script": r"<script\b", "french": r'lang="fr"', "list": r"<li>|<ul>"}
    )


@on_tables
def conversation_roles(t):
    return P.distribution(t("conversations"), "role", n="turns")


@on_tables
def conversation_tokens(t):
    """Comma-separated pieces of whole turns, by the conversations they occur in."""
    turns = T.explode_list(t("conversations"), "text", ["conv_id", "turn"])
    counts = T.term_counts(turns, key="conv_id", n="conv_count")
    return top(counts, 30, "conv_count", "skill_term")


@on_tables
def order_priorities(t):
    return P.rounded_distribution(t("orders"), "o_orderpriority", "orders", places=2)


@on_tables
def order_dates(t):
    return P.temporal_coverage(t("orders"), "o_orderdate")


@on_tables
def shipping_dates(t):
    return P.temporal_coverage(t("lineitem"), "l_shipdate")


@on_tables
def event_days(t):
    return P.temporal_coverage(t("events"), "ts")


@on_tables
def event_type_rate(t):
    flagged = t("events").select("event_type", (F.col("value") > 50).cast("int").alias("high"))
    return P.rate(flagged, "high", "event_type")


@on_tables
def customer_orders_top(t):
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return P.top_with_groups(orders, "c_name", 30, groups="distinct_customers")


@on_tables
def part_name_fragmentation(t):
    return P.fragmentation(t("part"), "p_name")


@on_tables
def lineitem_repeats(t):
    return R.repeat_audit(t("lineitem"), ["l_partkey", "l_suppkey"], normalize=False)


@on_tables
def segment_share(t):
    """Share of customers with an order of each status, per market segment, as rows."""
    customers = t("customer")
    rows = customers.join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    base = rows_of(customers)
    status = F.col("o_orderstatus")
    shares = P.conditional_share(
        rows, "c_mktsegment", "c_custkey", {s: (status == s, base) for s in ("F", "O", "P")}
    )
    return measures_to_rows(shares, ["c_mktsegment"], {"F": "finished", "O": "open", "P": "partial"})


QUERIES["handoff"] = QUERIES.pop("handoff_table")

from . import loading, sketches  # noqa: E402, F401  register further queries
