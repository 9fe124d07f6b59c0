"""The target population."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.text import contains_any, contains_ci, holds, or_empty
from ..operators.keys import KEY, enrich, match, restrict
from ..operators.marks import Marks
from ..operators.tokens import has_term
from ..sources.tables import write_parquet


@dataclass(frozen=True)
class CohortSpec:
    """Adverts with an anchor skill, a title phrase, or a related title family."""

    anchor_terms: tuple[str, ...] = L.ANCHOR_SKILLS
    title_phrases: tuple[str, ...] = L.TITLE_PHRASES
    title_exclusions: tuple[str, ...] = L.TITLE_EXCLUSIONS
    family_phrases: tuple[str, ...] = L.FAMILY_PHRASES
    country: str = "United States"
    unicode_space: bool = False


STANDARD = CohortSpec()
# The cleaning job keeps titles that also mention the excluded phrase and trims all white space.
CLEANING = CohortSpec(title_exclusions=(), unicode_space=True)


def _explicit(title: Column, spec: CohortSpec) -> Column:
    hit = contains_any(title, spec.title_phrases)
    return hit & ~contains_any(title, spec.title_exclusions) if spec.title_exclusions else hit


def title_test(title, spec: CohortSpec = STANDARD) -> Column:
    """The explicit title rule. A NULL title does not pass."""
    return holds(F.lower(or_empty(title)), lambda t: _explicit(t, spec))


def family_test(title, spec: CohortSpec = STANDARD) -> Column:
    """The related title families."""
    return contains_ci(or_empty(title), *spec.family_phrases)


def any_title_test(title, spec: CohortSpec = STANDARD) -> Column:
    """Either title rule."""
    return holds(F.lower(or_empty(title)), lambda t: _explicit(t, spec) | contains_any(t, spec.family_phrases))


def skill_test(skills, spec: CohortSpec = STANDARD) -> Column:
    return has_term(skills, spec.anchor_terms, unicode_space=spec.unicode_space)


def skill_confirmed(skills: DataFrame, spec: CohortSpec = STANDARD) -> DataFrame:
    """Keys with an anchor skill; a key may repeat."""
    return skills.filter(skill_test("job_skills", spec)).select(KEY)


def cohort_members(postings: DataFrame, skills: DataFrame, spec: CohortSpec = STANDARD) -> DataFrame:
    """Keys of the population, a key possibly more than once. One pass tests both title rules."""
    titled = postings.filter(any_title_test("job_title", spec)).select(KEY)
    return skill_confirmed(skills, spec).unionByName(titled)


def build_cohort(postings: DataFrame, skills: DataFrame, spec: CohortSpec = STANDARD) -> DataFrame:
    """Distinct keys of the population, all countries."""
    return cohort_members(postings, skills, spec).distinct()


BY_SKILL, BY_TITLE, BY_FAMILY = "skill rule", "title rule", "title family"


def cohort_marks(postings: DataFrame, skills: DataFrame, spec: CohortSpec = STANDARD) -> Marks:
    """Which of the rules each key meets, from one scan of each table."""
    titles = {BY_TITLE: title_test("job_title", spec), BY_FAMILY: family_test("job_title", spec)}
    return Marks([(skills, {BY_SKILL: skill_test("job_skills", spec)}), (postings, titles)])


def cohort_postings(
    postings: DataFrame,
    skills: DataFrame,
    spec: CohortSpec = STANDARD,
    everywhere: bool = False,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Postings of the population, in the country of the definition unless ``everywhere``.

    ``keys`` is a population saved before; without it the rules are run.
    """
    rows = postings if everywhere else postings.filter(F.col("search_country") == spec.country)
    return restrict(rows, cohort_members(postings, skills, spec) if keys is None else keys)


def cohort_in_country(postings: DataFrame, skills: DataFrame, spec: CohortSpec = STANDARD) -> DataFrame:
    return cohort_postings(postings, skills, spec).select(KEY)


def save_cohort(postings: DataFrame, skills: DataFrame, path: str, spec: CohortSpec = STANDARD) -> tuple[DataFrame, int]:
    """Writes the keys of the population in its country; returns the stored table and its rows.

    The jobs that follow take it as ``keys``. They then neither repeat the rules nor guess
    the size of the population.
    """
    rows = write_parquet(cohort_in_country(postings, skills, spec), path)
    return postings.sparkSession.read.parquet(path), rows


def cohort_with_skills(
    postings: DataFrame,
    skills: DataFrame,
    spec: CohortSpec = CLEANING,
    keys: DataFrame | None = None,
) -> DataFrame:
    """The table the cleaning job starts from: postings of the population and their skills."""
    base = cohort_postings(postings, skills, spec, keys=keys)
    return enrich(base, skills, within=keys).drop("search_country")


def cohort_skill_lists(
    postings: DataFrame, skills: DataFrame, spec: CohortSpec = CLEANING, keys: DataFrame | None = None
) -> DataFrame:
    """Key and skill list of the adverts of the population that have one: all the skill mart needs."""
    base = cohort_postings(postings, skills, spec, keys=keys).select(KEY)
    return match(base, skills if keys is None else restrict(skills, keys))
