"""Rankings before and after removing repeated adverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import ANCHOR_SKILLS
from ..functions.numbers import pct
from ..operators.keys import KEY, restrict
from ..operators.marks import top_of_each
from ..operators.profile import every
from ..operators.repeats import POSTING_KEYS, keep_first, repeat_audit
from ..operators.tokens import explode_list
from ..sources.tables import stored

ORIGINAL, REDUCED = "Original", "Sensitivity"


def sensitivity_population(us_postings: DataFrame) -> DataFrame:
    """The lowest key of each normalised title, company and location."""
    return keep_first(us_postings)


def sensitivity_counts(us_postings: DataFrame) -> DataFrame:
    """Adverts before and after the removal, which leaves one per combination."""
    audit = repeat_audit(us_postings)
    before, after = F.col("total"), F.col("combinations")
    return audit.select(
        before.alias("original_population"),
        after.alias("sensitivity_population"),
        (before - after).alias("potential_repeated_records_removed"),
        pct(before - after, before).alias("percentage_removed"),
    )


def marked_population(us_postings: DataFrame) -> DataFrame:
    """Key, title, company and location: the population with _all 1, then what the removal leaves with _kept 1.

    Written to the shared folder once: the postings are scanned once, whatever is compared.
    """
    population = stored(us_postings.select(KEY, *POSTING_KEYS), "sensitivity_population")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    every_row = population.select("*", one.alias("_all"), none.alias("_kept"))
    left = sensitivity_population(population).select("*", none.alias("_all"), one.alias("_kept"))
    return stored(every_row.unionByName(left), "sensitivity_marked")


def _summed(rows: DataFrame) -> DataFrame:
    """_all and _kept of each value."""
    return rows.groupBy("value").agg(every("_all").alias("_all"), every("_kept").alias("_kept"))


def _compared(counts: DataFrame, marked: DataFrame, k: int, bases: dict[str, int] | None) -> DataFrame:
    """The top values of both populations from value, _all, _kept."""
    ranked = top_of_each(counts, "value", {ORIGINAL: "_all", REDUCED: "_kept"}, k, "population", "job_count")
    totals = marked.agg(F.struct(every("_all").alias(ORIGINAL), every("_kept").alias(REDUCED))).scalar()
    base = {label: F.lit(bases[label]) if bases and label in bases else totals[label] for label in (ORIGINAL, REDUCED)}
    whole = F.when(F.col("population") == ORIGINAL, base[ORIGINAL]).otherwise(base[REDUCED])
    return ranked.withColumn("percentage", pct(F.col("job_count"), whole.cast("long")))


def compare_top_values(
    us_postings: DataFrame, value: Column, k: int = 10, bases: dict[str, int] | None = None
) -> DataFrame:
    """Top values of a title, company or location in both populations.

    Shares are of the population, or of the number ``bases`` gives for it.
    """
    marked = marked_population(us_postings)
    return _compared(_summed(marked.select(value.alias("value"), "_all", "_kept")), marked, k, bases)


def compare_top_titles(us_postings: DataFrame, k: int = 10, bases: dict[str, int] | None = None) -> DataFrame:
    return compare_top_values(us_postings, F.trim("job_title"), k, bases)


def compare_top_locations(us_postings: DataFrame, k: int = 10, bases: dict[str, int] | None = None) -> DataFrame:
    return compare_top_values(us_postings, F.col("job_location"), k, bases)


def compare_top_skills(
    us_postings: DataFrame, skills: DataFrame, k: int = 10, bases: dict[str, int] | None = None
) -> DataFrame:
    """Skills as written, anchors left out; the skill lists are scanned and split once."""
    marked = marked_population(us_postings)
    keys = marked.groupBy(KEY).agg(F.max("_all").alias("_all"), F.max("_kept").alias("_kept"))
    tokens = explode_list(restrict(skills, marked.select(KEY)), "job_skills", [KEY], out="value", fold_case=False)
    others = tokens.where(~F.lower("value").isin(*ANCHOR_SKILLS)).distinct().join(keys, KEY)
    return _compared(_summed(others), marked, k, bases)
