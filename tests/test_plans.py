"""Plans that matter at scale, and invariants of the composed jobs."""

import re

import pytest
from pyspark.sql import functions as F

from checks.adverts import Adverts
from checks.queries import QUERIES
from rolescope import schemas
from rolescope.operators import repeats as R
from rolescope.operators import keys as K
from rolescope.operators.keys import KEY
from rolescope.operators.skew import hot_keys as hot_keys_of
from rolescope.operators.skew import split_join
from rolescope.plans import cleaning, cohort, discovery, geography, handoff, quality, sensitivity, skills
from rolescope.session import prepare
from rolescope.sources.files import read_clean_postings, write_csv

from .conftest import SMALL


@pytest.fixture(scope="module")
def a(spark):
    return Adverts(spark, SMALL)


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n in names:
        spark.conf.unset(n)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.collect()
    return planned(df).split("== Initial Plan ==")[0]


def test_exclusion_is_an_anti_join(a):
    assert "LeftAnti" in planned(discovery.missed_titles(a.postings, a.skills))


def test_membership_is_a_semi_join(a):
    assert "LeftSemi" in planned(cohort.cohort_postings(a.postings, a.skills))


def test_definitions_scan_once(spark):
    plan = planned(QUERIES["compare_definitions"](spark, SMALL))
    assert plan.count("FileScan") == 1 and "Expand" not in plan


def test_ranks_are_limited_before_the_shuffle(spark):
    for name in ("sensitivity_keys", "family_sample", "document_first_copies"):
        assert re.search(r"WindowGroupLimit.*Partial", planned(QUERIES[name](spark, SMALL)))


def test_top_k_needs_no_full_sort(spark):
    for name in ("employer_top", "title_top", "state_top", "uncategorized_sample"):
        plan = planned(QUERIES[name](spark, SMALL))
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_total_reuses_the_shuffle_of_the_counts(spark, no_broadcast):
    assert "ReusedExchange" in executed(QUERIES["employer_top"](spark, SMALL))


def test_scan_reads_only_the_columns_it_needs(spark):
    plan = planned(QUERIES["document_sources"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<source:string>", plan)


def test_dimension_filter_reaches_the_scan(spark, tmp_path):
    rows = [tuple("x" for _ in schemas.POSTINGS.names)]
    spark.createDataFrame(rows, schemas.POSTINGS).write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("x", "y")], schemas.SKILLS).write.parquet(str(tmp_path / "s"))
    us = cohort.cohort_postings(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "s")))
    assert "EqualTo(search_country,United States)" in planned(us)


def hot(spark, n=40000):
    """A third of the rows has the same title, company and location, another part NULL ones."""
    i = F.col("id")
    text = lambda c: F.when(i % 3 == 0, c).when(i % 11 == 0, None).otherwise(F.concat(F.lit(c), i))
    return spark.range(0, n, 1, 8).select(
        F.concat(F.lit("l"), i).alias(KEY), text("title").alias("job_title"), text("co").alias("company"),
        text("place").alias("job_location"), F.repeat(F.lit("x"), 200).alias("pad"),
    )


@pytest.fixture
def eager_skew(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_hot_group_is_split_when_flagging_repeats(spark, eager_skew):
    flagged = R.flag_repeats(hot(spark))
    assert "skew=true" in executed(flagged.select(KEY, "pad", "is_likely_repost"))
    assert flagged.filter("is_likely_repost").count() == sum(i % 3 == 0 or i % 11 == 0 for i in range(40000))


def hot_keys(spark):
    """A third of the rows has one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("l1")).otherwise(F.col(KEY))
    return spark.range(0, 40000, 1, 8).withColumn(KEY, F.concat(F.lit("l"), "id")).select(
        key.alias(KEY), F.sha2(F.col(KEY), 512).alias("pad")
    )


def every_key(spark):
    return spark.range(0, 40000, 1, 8).select(F.concat(F.lit("l"), F.col("id")).alias(KEY), F.sha2(F.col("id").cast("string"), 512).alias("s"))


HOT = len(range(0, 40000, 3))


@pytest.mark.parametrize(
    "join, n",
    [
        (lambda hot, all_: K.restrict(hot, all_), 40000),
        (lambda hot, all_: K.exclude(hot, all_.filter("job_link like '%5'")), 40000 - 2667),
        (lambda hot, all_: K.enrich(hot, all_), 40000),
        # followed by an aggregation by the key of the join
        (lambda hot, all_: K.restrict(hot, all_).groupBy(KEY, "pad").count(), 40000),
    ],
)
def test_hot_key_is_split_in_joins(spark, eager_skew, join, n):
    prepare(spark)
    joined = join(hot_keys(spark), every_key(spark))
    assert "skew=true" in executed(joined)
    assert joined.count() == n


@pytest.mark.parametrize("swap", [False, True])
def test_hot_key_of_either_side_is_dealt_into_parts(spark, no_broadcast, swap):
    sides = [hot_keys(spark), every_key(spark)]
    left, right = sides[::-1] if swap else sides
    found = hot_keys_of(left, right, KEY, rows=1000)
    assert found.parts == {"l1": (1, 14) if swap else (14, 1)}
    joined = K.enrich(left, right, hot=found)
    assert joined.count() == (40000 + HOT if swap else 40000)
    # the join's own rows, by key and part: what one task reads of a key
    spread = split_join(left, right, found, KEY, how="inner")
    assert spread.count() == 40000
    plan = executed(joined)
    assert "_i" in plan and "_j" in plan and "LeftOuter" in plan


def test_handoff_takes_five_shuffles(a, spark, no_broadcast):
    # four more come from the join that makes the advert tables, read twice
    assert len(re.findall(r"ShuffleQueryStage", executed(handoff.handoff_table(a.postings, a.skills, a.summaries)))) == 9


def test_key_repeated_on_the_right_is_combined_before_the_shuffle(spark, no_broadcast):
    assert K.overlap_audit(every_key(spark), hot_keys(spark)).first().matched == 40000 - HOT


def test_first_of_a_hot_group_leaves_one_row_per_task(spark, no_broadcast):
    kept = R.keep_first(hot(spark))
    plan = executed(kept)
    assert "Partial" in plan and kept.count() == len({i if i % 3 and i % 11 else -(i % 3 == 0) for i in range(40000)})


# --- invariants ------------------------------------------------------------------------


def test_population_invariants(a):
    population = cohort.build_cohort(a.postings, a.skills)
    assert population.count() == population.distinct().count()
    us = cohort.cohort_in_country(a.postings, a.skills)
    assert us.join(population, KEY, "left_anti").count() == 0
    assert population.join(a.postings.select(KEY), KEY, "left_anti").count() == 0
    table = handoff.handoff_table(a.postings, a.skills, a.summaries)
    assert table.columns == schemas.HANDOFF.names and table.count() == us.count()


def test_saved_population_gives_the_same_tables(a, tmp_path):
    keys, n = cohort.save_cohort(a.postings, a.skills, str(tmp_path / "us"))
    assert n == keys.count()
    direct = handoff.handoff_table(a.postings, a.skills, a.summaries)
    saved = handoff.handoff_table(a.postings, a.skills, a.summaries, keys=keys)
    assert sorted(map(tuple, direct.collect()), key=repr) == sorted(map(tuple, saved.collect()), key=repr)


def test_cleaning_invariants(a, tmp_path, spark):
    combined = cohort.cohort_with_skills(a.postings, a.skills)
    cleaned = cleaning.clean_postings(combined)
    n = combined.count()
    export = cleaning.postings_export(cleaned)
    assert export.schema.names == schemas.POSTINGS_FINAL.names and export.count() == n
    assert [f.dataType for f in export.schema] == [f.dataType for f in schemas.POSTINGS_FINAL]
    states = geography.state_resolution(cleaned).first()
    assert states.resolved_us + states.non_us + states.unresolved == states.total == n
    assert cleaned.groupBy("role_category").count().agg(F.sum("count")).first()[0] == n
    assert cleaned.filter(F.col("job_title").contains("\u00a0")).count() == 0
    write_csv(export, str(tmp_path / "postings"))
    back = read_clean_postings(spark, str(tmp_path / "postings"))
    written = [tuple(None if v == "" else v for v in r) for r in export.collect()]  # an empty field is NULL
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(written, key=repr)


def test_skill_invariants(a):
    combined = cohort.cohort_with_skills(a.postings, a.skills)
    summary = skills.explode_summary(combined).first()
    assert summary.rows_exploded - summary.rows_kept == summary.empty_removed
    assert summary.rows_kept == skills.skill_mart(combined).count() and summary.postings == combined.count()


def test_sensitivity_invariants(a):
    us = cohort.cohort_postings(a.postings, a.skills)
    reduced = sensitivity.sensitivity_population(us)
    counts = sensitivity.sensitivity_counts(us).first()
    assert reduced.join(us, KEY, "left_anti").count() == 0
    assert (counts.original_population, counts.sensitivity_population) == (us.count(), reduced.count())


def test_fixed_denominators(a):
    us = cohort.cohort_postings(a.postings, a.skills)
    bases = {sensitivity.ORIGINAL: 1000, sensitivity.REDUCED: 500}
    for ranked in (
        sensitivity.compare_top_titles(us, 3, bases),
        sensitivity.compare_top_locations(us, 3, bases),
        sensitivity.compare_top_skills(us, a.skills, 3, bases),
    ):
        got = ranked.collect()
        assert len(got) == 6
        assert all(float(r.percentage) == round(100 * r.job_count / bases[r.population], 2) for r in got)


def test_checks_before_cleaning(a):
    checks = quality.checkpoint_checks(cohort.cohort_with_skills(a.postings, a.skills))
    assert set(checks) == {"duplicate_keys", "likely_reposts", "location", "encoding", "dates", "levels"}
    assert all(df.count() > 0 for df in checks.values())


def test_column_sets_match_the_reader(a):
    assert set(schemas.CLEANING_COLUMNS) <= set(a.postings.columns)
