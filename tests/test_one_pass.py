"""Marks, dictionaries, sketches, bitmaps, large samples and audits by batch, against plain versions."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from checks.adverts import Adverts
from checks.queries import QUERIES
from rolescope.operators import bitmaps, increments, sample
from rolescope.operators.dictionary import ROWS, by_value, resolve
from rolescope.operators.distinct_sketches import distinct_sketches, error_bound, merged_counts
from rolescope.operators.heavy_top import top_terms, top_values
from rolescope.operators.keys import restrict
from rolescope.operators.marks import Marks, top_of_each
from rolescope.operators.profile import distribution, missing_audit, table_profile, temporal_coverage
from rolescope.plans import cleaning, sensitivity

from .conftest import SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


# marks


def test_marks_are_set_algebra(spark):
    pick = random.Random(1)
    one = [(pick.choice(["a", "b", "c", "d", None]), pick.randrange(6)) for _ in range(12)]
    two = [(pick.choice(["c", "d", "e", "f"]), pick.randrange(6)) for _ in range(9)]
    a, b = (spark.createDataFrame(x, "job_link string, n int") for x in (one, two))
    n = F.col("n")
    marks = Marks([(a, {"low": n < 2, "even": n % 2 == 0}), (b, {"high": n > 2})])
    low, even, high = {k for k, x in one if x < 2}, {k for k, x in one if x % 2 == 0}, {k for k, x in two if x > 2}
    sets = {"low": low, "both": low & even, "low only": low - even - high, "any": low | even | high}
    tests = {
        "low": marks.has("low"), "both": marks.has("low") & marks.has("even"),
        "low only": marks.has("low") & ~marks.has("even", "high"), "any": marks.has("low", "even", "high"),
    }
    assert rows(marks.counts(tests)) == sorted(((label, len(s)) for label, s in sets.items()), key=repr)
    assert {r[0] for r in marks.select(tests["low only"]).collect()} == sets["low only"]
    with pytest.raises(ValueError):
        Marks([(a, {"x": n > 1}), (b, {"x": n > 1})])


def test_overlap_scans_each_table_once_and_groups_once(spark):
    plan = planned(QUERIES["cleaning_cohort_overlap"](spark, SMALL))
    # postings are made of two test tables, skills of one
    assert plan.count("FileScan") == 3 and len(re.findall(r"HashAggregate\(keys=\[job_link", plan)) == 2


def test_top_of_each_is_two_top_lists(spark):
    pick = random.Random(4)
    data = [(f"v{i}", pick.randrange(5), pick.randrange(3)) for i in range(40)] + [(None, 4, 0)]
    df = spark.createDataFrame(data, "value string, x long, y long")
    got = rows(top_of_each(df, "value", {"one": "x", "two": "y"}, 5, "list", "n"))
    expected = []
    for label, i in (("one", 1), ("two", 2)):
        best = sorted((r for r in data if r[i] > 0), key=lambda r: (-r[i], r[0] is not None, r[0] or ""))[:5]
        expected += [(label, r[0], r[i]) for r in best]
    assert got == sorted(expected, key=repr)


def test_sensitivity_reads_the_stored_population(spark):
    a = Adverts(spark, SMALL)
    postings = a.postings.select("job_link", "job_title", "company", "job_location")
    twice = postings.unionByName(postings.limit(40))  # repeated keys count as rows
    before, after = sensitivity.sensitivity_counts(twice).first()[:2]
    ranked = sensitivity.compare_top_locations(twice, 1000)
    totals = dict(rows(ranked.groupBy("population").agg(F.sum("job_count"))))
    assert totals == {"Original": before, "Sensitivity": after}
    assert not re.search(r"orders.parquet|customer.parquet", planned(ranked))


# dictionaries


def test_derived_columns_are_joined_back(spark):
    data = [("a, TX", 1), (None, 2), ("a, TX", 3), ("", 4), ("b, NY", 5), (None, 6)]
    df = spark.createDataFrame(data, "job_location string, n int")
    direct = cleaning.with_state(df)
    assert rows(cleaning.locate(df).select(*direct.columns)) == rows(direct)
    named = resolve(df, "job_location", lambda v: v.withColumn("n", F.coalesce(F.length("job_location"), F.lit(-1))))
    assert rows(named.select("job_location", "n")) == sorted(((t, -1 if t is None else len(t)) for t, _ in data), key=repr)
    assert rows(by_value(df, "job_location")) == sorted([("a, TX", 2), (None, 2), ("", 1), ("b, NY", 1)], key=repr)


@pytest.mark.parametrize("name, column", [("state_top", "job_location"), ("state_resolution", "job_location"), ("role_final", "job_title")])
def test_values_are_grouped_before_they_are_read(spark, name, column):
    plan = planned(QUERIES[name](spark, SMALL))
    lowest = [line for line in plan.splitlines() if "HashAggregate" in line and "partial_count(1)" in line]
    assert any(re.search(rf"keys=\[{column}", line) for line in lowest)


@pytest.mark.parametrize("limit, join", [("-1", "SortMergeJoin"), ("10MB", "BroadcastHashJoin")])
def test_the_size_of_the_dictionary_decides_the_join(spark, limit, join):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        df = spark.range(1000).select(F.format_string("p%d, TX", F.col("id") % 9).alias("job_location"))
        assert join in planned(cleaning.locate(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# sketches


def test_sketches_add_up_within_their_bound(spark):
    df = spark.range(60000).select((F.col("id") % 7).alias("g"), (F.col("id") % 20011).alias("v"), (F.col("id") % 13).alias("day"))
    stored = distinct_sketches(df, ["g", "day"], "v")
    exact = dict(rows(df.groupBy("g").agg(F.count_distinct("v"))))
    for r in merged_counts(stored, ["g"]).collect():
        assert abs(r.distinct_values - exact[r.g]) <= error_bound() * exact[r.g]
    assert abs(merged_counts(stored).first()[0] - 20011) <= error_bound() * 20011
    few = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "g int, v string")
    assert rows(merged_counts(distinct_sketches(few, ["g"], "v"), ["g"])) == [(1, 1), (2, 0)]
    assert merged_counts(distinct_sketches(few.where("1 = 0"), ["g"], "v")).first()[0] == 0


def plain_top(values, k):
    return sorted(((v, n) for v, n in Counter(v for v in values if v is not None).items()), key=lambda x: (-x[1], x[0]))[:k]


def test_top_lists_on_skewed_and_flat_data(spark):
    skewed = [f"v{i:03}" for i in range(40) for _ in range(5 * i)] + [f"u{i}" for i in range(2000)] + [None] * 300
    flat = [f"f{i:04}" for i in range(3000)] * 2
    for values, proved in ((skewed, True), (flat, False)):
        df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
        best, sure = top_values(df, "v", 10, "n", tracked=1000)
        assert [tuple(r) for r in best.collect()] == plain_top(values, 10) and sure is proved
    tokens = spark.createDataFrame([(f"t{i % (j + 1)}", f"k{j % 50}") for j in range(60) for i in range(60)], "skill_term string, job_link string")
    best, _ = top_terms(tokens, 5)
    full = tokens.groupBy("skill_term").agg(F.count_distinct("job_link").alias("n")).orderBy(F.desc("n"), "skill_term")
    assert [tuple(r) for r in best.collect()] == [tuple(r) for r in full.limit(5).collect()]
    assert top_values(df.where("1 = 0"), "v", 3)[0].collect() == []


# bitmaps


def test_bitmap_membership_is_exact(spark):
    left = spark.range(20000).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("k"), "id")).alias("job_link"), "id")
    keys = spark.range(0, 20000, 7).select(F.concat(F.lit("k"), "id").alias("job_link")).unionByName(
        spark.createDataFrame([(None,), ("k1",), ("k1",)], "job_link string")
    )
    expected = rows(restrict(left, keys))
    for bits in (16, 20, 27):
        assert rows(bitmaps.restrict_large(left, keys, bits=bits)) == expected
    passed = bitmaps.possible_members(left, bitmaps.key_bitmap(keys, bits=20), bits=20).count()
    assert len(expected) <= passed < 1.02 * len(expected)  # chance hits: the share of bits that are set
    assert bitmaps.restrict_large(left, keys.where("1 = 0")).count() == 0


def test_rows_are_dropped_before_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = planned(QUERIES["lines_of_urgent_orders"](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    at = lambda text: next(i for i, line in enumerate(lines) if text in line)
    # read from below: the scan, the bit, the shuffle, the exact join
    assert at("LeftSemi") < at("Exchange hashpartitioning(l_orderkey") < at("getbit") < at("FileScan")


# samples


@pytest.mark.parametrize("k", [1, 40, 5000])
def test_large_samples_are_the_plain_draw(spark, k):
    pick = random.Random(k)
    data = [(f"k{i}", pick.choice(["hot"] * 6 + ["b", None])) for i in range(9000)] + [(None, "b"), (None, "b")]
    df = spark.createDataFrame(data, "job_link string, g string").repartition(4)
    got = sample.large_sample_per_group(df, "g", k)
    assert rows(got) == rows(sample.sample_per_group(df, "g", k))
    assert re.search(r"Window.*\[g#\d+, _slice#\d+\]", planned(got))  # no task has a whole group


# audits by batch


def test_audits_by_batch_equal_the_full_run(spark, tmp_path):
    whole = Adverts(spark, SMALL).postings.select("job_link", "job_type", "job_location", "first_seen")
    whole = whole.unionByName(whole.limit(9))
    folder, source = str(tmp_path / "state"), str(tmp_path / "source")
    part = F.pmod(F.xxhash64("job_link"), F.lit(3))
    for batch in (0, 1, 1, 2):
        whole.where(part == batch).write.mode("overwrite").parquet(source)  # the batch before is gone
        increments.add_batch(spark.read.parquet(source), whole.columns, folder, batch)
    assert rows(increments.table_profile(spark, folder, "p", "job_link")) == rows(table_profile({"p": whole}))
    assert rows(increments.distribution(spark, folder, "job_type")) == rows(distribution(whole, "job_type"))
    assert rows(increments.missing_audit(spark, folder, "job_location")) == rows(missing_audit(whole, "job_location"))
    assert rows(increments.temporal_coverage(spark, folder, "first_seen")) == rows(temporal_coverage(whole, "first_seen"))
    assert "PartitionFilters: [isnotnull(field" in planned(increments.values(spark, folder, "job_type"))
    assert increments.values(spark, folder, "job_type").agg(F.sum(ROWS)).first()[0] == whole.count()
