"""Hot keys found by sketch and split in joins, against the plain joins."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolescope.operators import skew
from rolescope.operators.keys import enrich


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tables(spark, seed, left_hot, right_hot):
    pick = random.Random(seed)

    def side(n, hot, hot_n):
        keys = [hot] * hot_n + [pick.choice([None, *(f"k{i}" for i in range(60))]) for _ in range(n)]
        return [(k, i) for i, k in enumerate(keys)]

    left = spark.createDataFrame(side(150, "k1", left_hot), "job_link string, n long").repartition(3)
    right = spark.createDataFrame(side(150, "k2", right_hot) + [("k1", 1000)] * 2, "job_link string, m long").repartition(3)
    return left, right


@pytest.mark.parametrize("left_hot, right_hot", [(0, 0), (300, 0), (0, 300), (300, 300)])
def test_split_join_is_the_plain_join(spark, left_hot, right_hot):
    left, right = tables(spark, left_hot + right_hot, left_hot, right_hot)
    hot = skew.hot_keys(left, right, "job_link", rows=40)
    assert set(hot.parts) == {k for k, n in (("k1", left_hot), ("k2", right_hot)) if n}
    assert rows(enrich(left, right, hot=hot)) == rows(left.join(right, "job_link", "left"))
    assert rows(skew.split_join(left, right, hot, "job_link", "inner")) == rows(left.join(right, "job_link"))


def test_parts_stay_small(spark):
    left, right = tables(spark, 7, 400, 400)
    hot = skew.hot_keys(left, right, "job_link", rows=50)
    by_part = Counter()
    part = lambda df, n: df.where("job_link = 'k1'").select(F.pmod(F.xxhash64(*df.columns), F.lit(n)).alias("p"))
    for r in part(left, hot.parts["k1"][0]).collect():
        by_part[r.p] += 1
    assert len(by_part) == hot.parts["k1"][0] > 6 and max(by_part.values()) < 100


def test_sketch_finds_what_it_promises(spark):
    values = [f"v{i}" for i in range(50) for _ in range(i)] + [f"u{i}" for i in range(3000)] + [None] * 500
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(8)
    counts = Counter(v for v in values if v is not None)
    expected = {v: n for v, n in counts.items() if n > 20}
    assert skew.heavy_counts(df, "v", rows=20) == expected
    assert skew.heavy_counts(df.where("1 = 0"), "v") == {} and skew.heavy_counts(df.where("v is null"), "v") == {}
    small = skew.likely_heavy(df, "v", tracked=1000)  # 7 / 1000 of the rows, or more
    assert {v for v, n in counts.items() if n > 0.007 * len(values)} <= set(small)


def test_only_inner_and_left(spark):
    left, right = tables(spark, 1, 0, 0)
    with pytest.raises(ValueError):
        skew.split_join(left, right, skew.HotKeys({}), "job_link", "full")
