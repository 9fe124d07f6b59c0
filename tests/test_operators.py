"""Operators against brute force over small rows, NULL keys and repeats included."""

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rolescope.operators import keys as K
from rolescope.operators import profile as P
from rolescope.operators import repeats as R
from rolescope.operators import sample as S
from rolescope.operators import tokens as T
from rolescope.operators.reshape import measures_to_rows
from rolescope.operators.totals import top, with_share


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def skills(spark):
    lists = [
        ("a", "SQL, Business Analysis , sql"), ("b", "a,,b,"), ("c", ""), ("d", None), ("e", "business analyst"),
        ("e", "Senior Business Analyst, Business Analytics"), (None, "business analysis"), ("f", "Lead Business Analyst"),
    ]
    return spark.createDataFrame(lists, "job_link string, job_skills string")


def test_explode(skills):
    tokens = T.explode_list(skills, "job_skills", ["job_link"])
    assert Counter(r[1] for r in tokens.collect() if r[0] in ("a", "b", "c", "d")) == Counter(
        ["sql", "business analysis", "sql", "a", "b"]
    )
    kept = T.explode_list(skills, "job_skills", ["job_link"], drop_empty=False).filter("job_link in ('b', 'c', 'd')")
    assert Counter(r[1] for r in kept.collect()) == Counter(["a", "", "b", "", ""])


def test_explode_strips_all_space(spark):
    lists = spark.createDataFrame([(1, "\u00a0A ,\tb\n,c"), (2, " d , e")], "i int, l string")
    tokens = T.explode_list(lists, "l", ["i"], out="t", unicode_space=True)
    assert rows(tokens) == [(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e")]


def test_split_list(values):
    assert values(lambda c: T.split_list(c), ["a, b ,,c ", "", None]) == [["a", "b", "", "c"], [""], None]
    assert values(lambda c: T.split_list(c, "|"), ["a| b"]) == [["a", "b"]]


def test_term_counts_count_a_key_once(skills):
    counts = dict(rows(T.term_counts(T.explode_list(skills, "job_skills", ["job_link"]))))
    assert counts["sql"] == 1 and counts["business analysis"] == 1


def test_definitions(skills):
    tokens = T.explode_list(skills, "job_skills", ["job_link"])
    tests = {
        "exact": lambda t: t == "business analysis",
        "either": lambda t: t.isin("business analysis", "business analyst"),
        "none": lambda t: t == "zzz",
    }
    assert rows(T.compare_definitions(tokens, tests)) == [("either", 2), ("exact", 1), ("none", 0)]
    assert rows(T.compare_definitions(tokens, {"exact": tests["exact"]})) == [("exact", 1)]


def test_broad_only(skills):
    tokens = T.explode_list(skills, "job_skills", ["job_link"])
    assert rows(T.broad_only(tokens, lambda t: t.contains("business analyst"))) == [("f", "lead business analyst")]


def test_key_sets(spark):
    one = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "job_link string")
    two = spark.createDataFrame([("b",), ("c",), ("b",)], "job_link string")
    assert rows(K.union_keys(one, two)) == [("a",), ("b",), ("c",), (None,)]
    assert rows(K.intersect_keys(one, two)) == [("b",)]
    assert rows(K.subtract_keys(one, two)) == [("a",), (None,)]
    assert rows(K.restrict(one, two)) == [("b",)]
    assert rows(K.exclude(one, two)) == [("a",), ("a",), (None,)]
    assert rows(K.overlap_audit(one, two)) == [(4, 1, 3)]
    assert rows(K.key_set(one, F.col("job_link") != "b")) == [("a",)]


def test_enrich(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "job_link string, n int")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("z", "w"), (None, "v")], "job_link string, s string")
    expected = [("a", 1, "x"), ("a", 1, "y"), ("b", 2, None), (None, 3, None)]
    assert rows(K.enrich(base, right)) == expected
    assert rows(K.enrich(base, right, within=base.select("job_link"))) == expected


def test_profile_and_coverage(spark):
    base = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "job_link string")
    one = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("z",)], "job_link string")
    two = spark.createDataFrame([("b",)], "job_link string")
    assert rows(P.table_profile({"base": base})) == [("base", 5, 3)]
    got = P.coverage_matrix(base, {"skills": one, "summary": two}).first().asDict()
    assert got == {
        "total_postings": 5, "postings_with_skills": 3, "postings_without_skills": 2, "postings_with_summary": 2,
        "postings_without_summary": 3, "postings_with_both": 2,
    }


def test_distribution(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,)], "d string")
    assert rows(P.distribution(df, "d")) == [("x", 2, Decimal("66.67")), (None, 1, Decimal("33.33"))]
    assert rows(P.rounded_distribution(df, "d")) == [("x", 2, 66.7)]
    assert rows(P.distribution(df, "d", base=8)) == [("x", 2, Decimal("25.00")), (None, 1, Decimal("12.50"))]
    assert rows(P.top_with_groups(df, "d", 1)) == [("x", 2, Decimal("66.67"), 2)]
    assert rows(with_share(df.limit(0).groupBy("d").agg(P.every().alias("job_count")))) == []


def test_audits(spark):
    df = spark.createDataFrame(
        [("a", "A ", "2024-01-12"), (None, "a", "2024-13-45"), ("  ", None, None), ("b", "c", "2024-01-12")],
        "x string, y string, d string",
    )
    assert rows(P.missing_audit(df, "x")) == [(4, 2, Decimal("50.00"), 3)]
    assert rows(P.missing_audit(df, "x", null_only=True)) == [(4, 1, Decimal("25.00"), 3)]
    got = P.temporal_coverage(df, "d").first()
    assert (got.total, got.valid, got.invalid, got.distinct_dates) == (4, 2, 2, 1)
    agree = P.agreement_audit(df, F.lower(F.trim("x")), F.lower(F.trim("y")), F.lit(False), F.lit(False)).first()
    assert (agree.matching, agree.nonmatching, agree.percentage_nonmatching) == (1, 1, Decimal("25.00"))
    empty = P.temporal_coverage(df.limit(0), "d").first()
    assert (empty.total, empty.valid, empty.earliest) == (0, 0, None)


def test_duplicate_keys_count_null_as_a_key(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "job_link string")
    assert rows(P.duplicate_key_audit(df)) == [(2,)]


def test_fragmentation(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    assert rows(P.fragmentation(df, "t")) == [(4, 3, 2, 1, 2, Decimal("66.67"))]


def test_completeness(spark):
    df = spark.createDataFrame([("a", "TX"), (None, "NON_US"), ("c", None)], "t string, state string")
    got = rows(P.completeness(df, ["t", "state"], {"state": ["NON_US"]}))
    assert got == [("state", 1, 2, "33.33%"), ("t", 2, 1, "66.67%")]


def test_rates(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("y", 0)], "g string, f int")
    assert rows(P.rate(df, "f", "g")) == [("x", 2, 1, 1, Decimal("50.00")), ("y", 1, 0, 1, Decimal("0.00"))]
    assert rows(P.rate(df.limit(0), "f")) == [(0, 0, 0, None)]


def test_patterns_and_encoding(spark):
    df = spark.createDataFrame([("office mgr",), ("mgrs",), (None,), ("a\u00a0â€“ mgr",)], "t string")
    assert rows(P.pattern_counts(df, "t", {"mgr": r"\bmgr\b", "x": "zzz"})) == [("mgr", 2), ("x", 0)]
    assert rows(P.encoding_audit(df, "t")) == [(1, 1)]


def test_removal_summary(spark):
    assert rows(P.removal_summary(spark.range(8), spark.range(7))) == [(8, 7, 1, Decimal("12.50"))]


def test_conditional_share(spark):
    df = spark.createDataFrame(
        [("s", "a", "core"), ("s", "a", "core"), ("s", "b", "other"), ("s", "c", None), ("t", "a", "core")],
        "skill string, job_link string, role string",
    )
    core = F.col("role") == "core"
    got = P.conditional_share(df, "skill", "job_link", {"all": (F.lit(True), 4), "core": (core, 2)})
    assert rows(got) == [("s", 0.75, 0.5), ("t", 0.25, 0.5)]
    long = measures_to_rows(got, ["skill"], {"all": "All", "core": "Core"})
    assert rows(long) == [("s", "All", 0.75), ("s", "Core", 0.5), ("t", "All", 0.25), ("t", "Core", 0.5)]


def postings(spark, n=3000, seed=1):
    """A third of the rows is one group, and some keys are NULL."""
    r = random.Random(seed)
    data = []
    for i in range(n):
        if i % 3 == 0:
            key = ("Hot", "Co", None)
        else:
            key = (r.choice(["A", "a ", None]), f"c{r.randrange(400)}", r.choice(["x", "X", None]))
        data.append((f"l{r.randrange(10**9):09d}-{i}", *key))
    return spark.createDataFrame(data, "job_link string, job_title string, company string, job_location string"), data


def key_of(row, normalize):
    return tuple(None if v is None else v.strip(" ").lower() if normalize else v for v in row[1:])


@pytest.mark.parametrize("normalize", [True, False])
@pytest.mark.parametrize("digest", [True, False])
def test_repeats(spark, normalize, digest):
    df, data = postings(spark)
    groups = defaultdict(list)
    for row in data:
        groups[key_of(row, normalize)].append(row[0])
    flagged = dict(R.flag_repeats(df, normalize=normalize, digest=digest).select("job_link", "is_likely_repost").collect())
    assert flagged == {link: len(g) > 1 for g in groups.values() for link in g}
    first = {r[0] for r in R.keep_first(df, normalize=normalize, digest=digest).select("job_link").collect()}
    assert first == {min(g) for g in groups.values()}
    many = [len(g) for g in groups.values() if len(g) > 1]
    audit = R.repeat_audit(df, normalize=normalize, digest=digest).first()
    assert tuple(audit)[:5] == (len(data), len(groups), len(many), sum(many), sum(many) - len(many))


def test_samples(spark):
    df, data = postings(spark, 900)
    once, again = (sorted(r[0] for r in S.sample_rows(df, 20, seed=42).collect()) for _ in range(2))
    assert once == again and len(set(once)) == 20
    assert once != sorted(r[0] for r in S.sample_rows(df.repartition(7), 20, seed=43).collect())
    drawn = S.sample_per_group(df, "company", 2)
    sizes = Counter(r["company"] for r in drawn.collect())
    assert sizes == {c: min(2, n) for c, n in Counter(d[2] for d in data).items()}


def test_top_breaks_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "t string, n int")
    assert [r[0] for r in top(df, 2, "n", "t").collect()] == ["c", "a"]
