"""Audits that justify each inclusion rule: what a rule would miss, and what that looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.rules import title_family
from ..functions.text import (
    contains_any, excludes_ci, has_any_phrase, has_token, like_ci, punct_to_space, text_preview,
)
from ..operators.keys import KEY, distinct_keys, enrich, exclude, overlap_audit
from ..operators.profile import rate, value_counts
from ..operators.sample import sample_per_group
from ..operators.tokens import broad_only, compare_definitions, explode_list, lists_mentioning, term_counts
from ..operators.totals import top
from ..sources.files import preview
from .cohort import skill_confirmed, title_test

TOPIC = "business analy"

DEFINITIONS = {
    "Exact Business Analysis only": lambda t: t == "business analysis",
    "Business Analysis or Business Analyst exact": lambda t: t.isin(*L.ANCHOR_SKILLS),
    "Broad BA-related terms excluding Business Analytics": lambda t: broad_term(t),
}


def broad_term(term: Column) -> Column:
    return contains_any(term, L.ANCHOR_SKILLS) & ~contains_any(term, L.TITLE_EXCLUSIONS)


def topic_terms(skills: DataFrame) -> DataFrame:
    """Tokens of the lists that mention an anchor term at all."""
    return explode_list(lists_mentioning(skills, "job_skills", L.ANCHOR_SKILLS), "job_skills", [KEY])


def term_preview(skills: DataFrame, n: int = 100) -> DataFrame:
    return preview(lists_mentioning(skills, "job_skills", [TOPIC]), [KEY, "job_skills"], n, order=[KEY])


def topic_term_counts(skills: DataFrame) -> DataFrame:
    tokens = explode_list(lists_mentioning(skills, "job_skills", [TOPIC]), "job_skills", [KEY])
    return term_counts(tokens.filter(F.col("skill_term").contains(TOPIC))).orderBy(F.desc("job_count"), "skill_term")


def definition_counts(skills: DataFrame) -> DataFrame:
    return compare_definitions(topic_terms(skills), DEFINITIONS)


def broad_only_terms(skills: DataFrame, n: int = 100) -> DataFrame:
    return broad_only(topic_terms(skills), broad_term).orderBy("skill_term", KEY).limit(n)


def title_overlap(postings: DataFrame, skills: DataFrame) -> DataFrame:
    titled = postings.filter(title_test("job_title"))
    return overlap_audit(
        titled,
        skill_confirmed(skills),
        names=("total_business_analyst_titled_jobs", "already_skill_confirmed", "missed_by_skill_rule"),
    )


def _titles(rows: DataFrame, n: int) -> DataFrame:
    return top(value_counts(rows, F.trim("job_title"), "job_title"), n, "job_count", "job_title")


def missed_titles(postings: DataFrame, skills: DataFrame, n: int = 100) -> DataFrame:
    """Titles under the title rule whose adverts have no anchor skill."""
    titled = postings.filter(title_test("job_title"))
    return _titles(exclude(titled, skill_confirmed(skills)), n)


def wide_pattern_titles(postings: DataFrame, skills: DataFrame, n: int = 100) -> DataFrame:
    """Titles of a wider pattern that no rule covers."""
    wide = postings.filter(
        like_ci("job_title", "%business%analyst%") & excludes_ci("job_title", *L.TITLE_PHRASES, *L.TITLE_EXCLUSIONS)
    )
    return _titles(exclude(wide, skill_confirmed(skills)), n)


def family_candidates(postings: DataFrame, skills: DataFrame) -> DataFrame:
    """Adverts of the related title families that the skill and title rules miss."""
    rows = postings.select(KEY, "job_title", title_family("job_title").alias("candidate_title_family"))
    rows = rows.filter(F.col("candidate_title_family").isNotNull() & excludes_ci("job_title", *L.TITLE_PHRASES))
    return exclude(rows, skill_confirmed(skills))


def family_counts(postings: DataFrame, skills: DataFrame) -> DataFrame:
    return value_counts(family_candidates(postings, skills), "candidate_title_family").orderBy(
        F.desc("job_count"), "candidate_title_family"
    )


def family_sample(
    postings: DataFrame, skills: DataFrame, summaries: DataFrame, k: int = 15, chars: int = 700, seed: int = 42
) -> DataFrame:
    """k adverts of each family with their skills and the head of their description."""
    drawn = sample_per_group(family_candidates(postings, skills), "candidate_title_family", k, seed=seed)
    few = F.broadcast(drawn.select(KEY))  # at most k keys of each family
    skills, summaries = (df.join(few, KEY, "left_semi") for df in (skills, summaries))
    full = enrich(enrich(drawn, skills), summaries)
    return full.select(
        "candidate_title_family",
        "sample_number",
        "job_title",
        "job_skills",
        text_preview("job_summary", chars).alias("job_summary_preview"),
    ).orderBy("candidate_title_family", "sample_number")


def with_evidence(candidates: DataFrame, skills: DataFrame, summaries: DataFrame) -> DataFrame:
    """Adds the 0/1 flag for an evidence phrase in the skills or the description.

    The phrases are sought where the texts are scanned and only the keys that have one
    are shuffled and joined, never the texts.
    """
    found = [
        df.filter(has_any_phrase([c], L.EVIDENCE_PHRASES) == 1).select(KEY)
        for df, c in ((skills, "job_skills"), (summaries, "job_summary"))
    ]
    keys = distinct_keys(found[0].unionByName(found[1])).withColumn("_found", F.lit(1))
    marked = candidates.join(keys, KEY, "left")
    return marked.withColumn("has_ba_activity_evidence", F.coalesce("_found", F.lit(0))).drop("_found")


_EVIDENCE = ("jobs_with_ba_evidence", "jobs_without_ba_evidence", "percentage_with_ba_evidence")


def evidence_by_family(postings: DataFrame, skills: DataFrame, summaries: DataFrame) -> DataFrame:
    flagged = with_evidence(family_candidates(postings, skills), skills, summaries)
    return rate(
        flagged, "has_ba_activity_evidence", "candidate_title_family", ("total_candidate_jobs", *_EVIDENCE)
    ).orderBy("candidate_title_family")


def acronym_candidates(postings: DataFrame, skills: DataFrame, token: str = "ba") -> DataFrame:
    """Adverts whose title has the acronym standing alone and that no rule covers."""
    rows = postings.select(KEY, "job_title").filter(
        has_token(punct_to_space("job_title"), token) & excludes_ci("job_title", *L.TITLE_PHRASES, *L.FAMILY_PHRASES)
    )
    return exclude(rows, skill_confirmed(skills))


def acronym_count(postings: DataFrame, skills: DataFrame) -> DataFrame:
    return acronym_candidates(postings, skills).agg(F.count(F.lit(1)).alias("ba_acronym_candidate_jobs"))


def acronym_titles(postings: DataFrame, skills: DataFrame, n: int = 100) -> DataFrame:
    return _titles(acronym_candidates(postings, skills), n)


def acronym_evidence(postings: DataFrame, skills: DataFrame, summaries: DataFrame) -> DataFrame:
    flagged = with_evidence(acronym_candidates(postings, skills), skills, summaries)
    return rate(flagged, "has_ba_activity_evidence", names=("total_ba_acronym_candidates", *_EVIDENCE))
