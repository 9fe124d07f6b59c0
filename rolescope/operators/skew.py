"""Hot keys: found by a sketch, counted exactly, and split in joins.

A key with more rows than one task should read is dealt into parts on the side where it is
hot, and its rows of the other side are repeated for every part. All other keys join as they
are; the work added is a look into a small table of hot keys on both sides.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task may read; keys the sketch follows and keys it may return.
ROWS, TRACKED, MOST = 1_000_000, 20_000, 5_000
#: Sketches are merged in this many groups before they meet in one task.
MERGE_GROUPS = 64


def likely_heavy(df: DataFrame, col: str, most: int = MOST, tracked: int = TRACKED) -> list:
    """Values that the frequent-items sketch is sure of, one pass without a shuffle of values.

    Every value with more than 7 / ``tracked`` of the rows is among them, if ``most`` allows.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_v"))
    group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("_g")
    sketches = values.groupBy(group).agg(F.expr(f"approx_top_k_accumulate(_v, {tracked})").alias("_s"))
    # by a constant: without a value there is no sketch to combine
    merged = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(_s, {tracked})").alias("_s"))
    found = merged.select(F.expr(f"approx_top_k_estimate(_s, {min(most, tracked)})").alias("top")).first()
    return [item["item"] for item in found["top"] or []] if found else []


def heavy_counts(df: DataFrame, col: str, rows: int = ROWS, **options) -> dict:
    """Values of more than ``rows`` rows with their exact number of rows."""
    likely = likely_heavy(df, col, **options)
    if not likely:
        return {}
    counts = df.where(F.col(col).isin(likely)).groupBy(col).count().where(F.col("count") > rows)
    return {r[0]: r[1] for r in counts.collect()}  # at most ``most`` rows


@dataclass(frozen=True)
class HotKeys:
    """For each hot key the parts that the left and the right side's rows are dealt into."""

    parts: Mapping[object, tuple[int, int]]

    def table(self, df: DataFrame, key: str) -> DataFrame:
        """key, _l, _r: at most 2 * MOST rows, so it may be sent to all tasks."""
        kind = df.schema[key].dataType.simpleString()
        rows = [(k, left, right) for k, (left, right) in self.parts.items()]
        return F.broadcast(df.sparkSession.createDataFrame(rows, f"`{key}` {kind}, _l int, _r int"))


def hot_keys(left: DataFrame, right: DataFrame, key: str, rows: int = ROWS, **options) -> HotKeys:
    """The keys of ``left`` and ``right`` with more than ``rows`` rows on one of them.

    ``left`` may be a table that holds the left side of the join; ``right`` must be the right
    side itself, or its rows before a restriction that keeps all partners.
    """
    many = [heavy_counts(df, key, rows, **options) for df in (left, right)]
    return HotKeys({k: tuple(ceil(side.get(k, 1) / rows) for side in many) for k in many[0].keys() | many[1].keys()})


def split_join(left: DataFrame, right: DataFrame, hot: HotKeys, key: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right`` by the key, inner or left outer, hot keys in parts.

    Rows are dealt by a hash of all their columns, so a task that runs again deals them alike;
    rows that are equal throughout share a part.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    if not hot.parts:
        return left.join(right, key, how)
    one = F.lit(1)

    def dealt(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        known = df.join(hot.table(df, key), key, "left")
        parts, copies = F.coalesce(own, one), F.coalesce(other, one)
        part = F.when(parts > 1, F.pmod(F.xxhash64(*df.columns), parts).cast("int")).otherwise(0)
        every = F.explode(F.sequence(F.lit(0), copies - 1))
        return known.select(*df.columns, part.alias(names[0]), every.alias(names[1]), parts.alias(f"_n{own}"))

    a = dealt(left, "_l", "_r", ("_i", "_j")).drop("_n_l")
    b = dealt(right, "_r", "_l", ("_j", "_i")).withColumn("_there", F.lit(True))
    joined = a.join(b, [key, "_i", "_j"], how)
    if how == "left":
        # a hot key of the right side has rows there, so a part without a partner says nothing
        many = [k for k, (_, n) in hot.parts.items() if n > 1]
        if many:
            joined = joined.where(F.col("_there").isNotNull() | F.coalesce(~F.col(key).isin(many), F.lit(True)))
    return joined.drop("_i", "_j", "_n_r", "_there")
