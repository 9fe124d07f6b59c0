"""Populations as one-column key sets, and the joins with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import HotKeys, split_join

KEY = "job_link"


def key_set(df: DataFrame, test: Column, key: str = KEY) -> DataFrame:
    """Distinct keys of the rows that pass the test."""
    return df.filter(test).select(key).distinct()


def union_keys(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def distinct_keys(keys: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct keys for the right side of a join.

    A key that repeats without end is combined before the shuffle. AQE splits a hot key of
    the left side only where both sides come straight from a shuffle; grouping by a struct
    keeps the join from taking over the partitions of the distinct.
    """
    return keys.select(F.struct(key).alias("_key")).distinct().select(F.col("_key")[key].alias(key))


def restrict(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is in the set; the set may repeat keys."""
    return df.join(distinct_keys(keys, key), key, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is not in the set; a NULL key is in no set."""
    return df.join(distinct_keys(keys, key), key, "left_anti")


def match(base: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Inner join in which a hot key of either side can be split.

    A side that comes out of another join by the same key would be joined where it lies,
    out of AQE's reach. The hash as a second join key makes Spark shuffle both sides.
    """
    sides = (df.withColumn("_hash", F.xxhash64(key)) for df in (base, right))
    return next(sides).join(next(sides), [key, "_hash"]).drop("_hash")


def enrich(
    base: DataFrame,
    right: DataFrame,
    key: str = KEY,
    within: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Left outer join; a repeated right key repeats the base row.

    ``within`` is a key set that covers the base. A stored one has a known size: if it is
    small Spark sends it to the scan of the right side, and texts nobody asks for are
    dropped there instead of being shuffled.

    By itself the join reuses a partitioning by the key, and AQE splits a hot key of the base.
    ``hot`` (``skew.hot_keys`` of these two tables) splits hot keys of both sides.
    """
    if within is not None:
        right = restrict(right, within, key)
    return base.join(right, key, "left") if hot is None else split_join(base, right, hot, key)


def overlap_audit(
    df: DataFrame,
    keys: DataFrame,
    key: str = KEY,
    names: tuple[str, str, str] = ("total", "matched", "missed"),
) -> DataFrame:
    """Rows, rows whose key is in the set, rows whose key is not."""
    total, matched, missed = names
    marked = df.select(key).join(distinct_keys(keys, key).withColumn("_hit", F.lit(1)), key, "left")
    hit = F.count("_hit")
    every = F.count(F.lit(1))
    return marked.agg(every.alias(total), hit.alias(matched), (every - hit).alias(missed))
