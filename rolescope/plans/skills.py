"""One row per advert and skill, and the skills that accompany the target capability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.lookups import ANCHOR_SKILLS, SKILL_SYNONYMS
from ..functions.numbers import pct_even
from ..functions.rules import canonical
from ..functions.text import fold
from ..operators.keys import KEY, restrict
from ..operators.profile import count_where, every
from ..operators.tokens import complementary_counts, explode_list, term_counts
from ..operators.totals import as_base, rows_of, top


def population_tokens(keys: DataFrame, skills: DataFrame, fold_case: bool = False) -> DataFrame:
    """Skills of a population as written, trimmed only; lower-cased with ``fold_case``."""
    return explode_list(restrict(skills, keys), "job_skills", [KEY], out="skill", fold_case=fold_case)


def top_raw_skills(
    keys: DataFrame,
    skills: DataFrame,
    k: int = 30,
    base=None,
    share: str = "percentage_of_us_ba_jobs",
    fold_case: bool = False,
) -> DataFrame:
    """Most frequent skills as written, anchors left out, as a share of the population."""
    base = keys if base is None else base
    tokens = population_tokens(keys, skills, fold_case)
    return top(complementary_counts(tokens, base, share=share), k, "job_count", "skill")


def exploded(combined: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Advert key and one skill per row, with its case-folded form."""
    rows = explode_list(
        combined,
        "job_skills",
        [KEY],
        out="job_skills",
        fold_case=False,
        unicode_space=True,
        drop_empty=drop_empty,
    )
    return rows.withColumn("job_skills_normalized", fold("job_skills"))


def skill_mart(combined: DataFrame, synonyms: dict[str, str] = SKILL_SYNONYMS) -> DataFrame:
    """The skills export. Synonyms may repeat a skill within an advert; they are kept."""
    rows = exploded(combined).withColumn("job_skills_normalized", canonical("job_skills_normalized", synonyms))
    return rows.select(*schemas.SKILLS_FINAL.names)


def explode_summary(combined: DataFrame) -> DataFrame:
    """Adverts, rows with and without empty tokens, distinct skills before and after folding.

    A missing list counts as one empty token.
    """
    filled = combined.withColumn("job_skills", F.coalesce("job_skills", F.lit("")))
    rows = exploded(filled, drop_empty=False)
    # Skills, folded skills and empty tokens of each distinct spelling, then of each folding:
    # two small aggregations instead of two distinct counts over all rows.
    spelled = rows.groupBy("job_skills", "job_skills_normalized").agg(every().alias("_n"))
    real = F.col("job_skills") != ""
    folded = spelled.groupBy("job_skills_normalized").agg(
        F.sum("_n").alias("_n"),
        count_where(real).alias("_spellings"),
        F.max(real.cast("int")).alias("_real"),
    )
    total = F.coalesce(F.sum("_n"), F.lit(0))
    kept = F.coalesce(F.sum(F.when(F.col("_real") == 1, F.col("_n"))), F.lit(0))
    return folded.agg(
        total.alias("rows_exploded"),
        kept.alias("rows_kept"),
        (total - kept).alias("empty_removed"),
        F.coalesce(F.sum("_spellings"), F.lit(0)).alias("distinct_before"),
        count_where(F.col("_real") == 1).alias("distinct_after"),
    ).withColumn("postings", rows_of(combined))


def top_skills(mart: DataFrame, base, k: int = 20, anchors=ANCHOR_SKILLS) -> DataFrame:
    """Most frequent normalised skills, counted once per advert, with a half-even rounded share."""
    others = mart.filter(~F.col("job_skills_normalized").isin(*anchors))
    counts = term_counts(others, "job_skills_normalized")
    ranked = counts.withColumn("percentage", pct_even(F.col("job_count"), as_base(base), 2))
    return top(ranked, k, "job_count", "job_skills_normalized")
