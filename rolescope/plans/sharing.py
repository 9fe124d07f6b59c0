"""The skill-share view: how often each chosen skill is listed, overall and by role group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.rules import role_group, skill_group
from ..operators.keys import KEY
from ..operators.profile import conditional_share, count_where
from ..operators.reshape import measures_to_rows

# measure -> displayed name
MEASURES = {
    "all_share": L.ALL_GROUP_LABEL,
    "core_share": L.CORE_GROUP_LABEL,
    "other_share": L.OTHER_GROUP_LABEL,
}
SHOWN = ("all_share", "core_share")


def advert_skills(postings_final: DataFrame, skills_final: DataFrame) -> DataFrame:
    """Adverts with their skills; adverts without skills stay.

    Both sides are made distinct first. The shares count adverts, so nothing is lost, and
    the combine before the shuffle leaves a few rows of a key that repeats without end.
    """
    roles = postings_final.select(KEY, "role_category").distinct()
    return roles.join(skills_final.select(KEY, "job_skills_normalized").distinct(), KEY, "left")


def skill_shares(
    postings_final: DataFrame,
    skills_final: DataFrame,
    skills: Sequence[str] = L.SHARE_SKILLS,
    bases: dict[str, int] | None = None,
) -> DataFrame:
    """Three shares per chosen skill, with its skill group.

    The denominators are the sizes of the role groups unless ``bases`` fixes them.
    """
    core = F.col("role_category") == L.CORE_ROLE
    other = F.col("role_category") != L.CORE_ROLE
    tests = {"all_share": F.lit(True), "core_share": core, "other_share": other}
    if bases is None:
        # one pass for the three sizes; Spark runs the repeated subquery once
        sizes = postings_final.agg(F.struct(*[count_where(t).alias(m) for m, t in tests.items()])).scalar()
        bases = {m: sizes[m] for m in tests}
    chosen = advert_skills(postings_final, skills_final).filter(F.col("job_skills_normalized").isin(*skills))
    shares = conditional_share(
        chosen, "job_skills_normalized", KEY, {m: (tests[m], bases[m]) for m in MEASURES}
    )
    return shares.withColumn("skill_group", skill_group("job_skills_normalized"))


def skill_share_view(
    postings_final: DataFrame, skills_final: DataFrame, measures: Sequence[str] = SHOWN, **options
) -> DataFrame:
    """One row per skill and shown measure."""
    shares = skill_shares(postings_final, skills_final, **options)
    return measures_to_rows(shares, ["job_skills_normalized"], {m: MEASURES[m] for m in measures}, value="share")


def role_groups(postings_final: DataFrame) -> DataFrame:
    return postings_final.groupBy(role_group("role_category").alias("role_group")).agg(
        F.count(F.lit(1)).alias("job_count")
    )
