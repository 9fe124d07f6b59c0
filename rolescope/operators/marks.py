"""Several populations in one pass: a bit for each definition, gathered once per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import count_where, rows_from

Tests = Mapping[str, Column]


class Marks:
    """Keys with the definitions they meet: columns ``key`` and ``_marks``, a row per key, NULL included.

    Every table is scanned once, whatever the number of its definitions, and one aggregation
    by key, combined before the shuffle, brings the tables together. Keys that meet none are
    dropped where they are scanned.
    """

    def __init__(self, sources: Sequence[tuple[DataFrame, Tests]], key: str = "job_link"):
        self.labels = [label for _, tests in sources for label in tests]
        if len(set(self.labels)) < len(self.labels) or len(self.labels) > 63:
            raise ValueError("definitions need names of their own, 63 at most")
        parts = []
        for df, tests in sources:
            bits = [F.when(test, F.lit(self.bit(label))).otherwise(F.lit(0)).cast("long") for label, test in tests.items()]
            marked = df.select(key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("_marks"))
            parts.append(marked.where("_marks <> 0"))
        self.keys = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.bit_or("_marks").alias("_marks"))

    def bit(self, label: str) -> int:
        return 1 << self.labels.index(label)

    def has(self, *labels: str) -> Column:
        """The key meets one of the definitions."""
        wanted = F.lit(sum(self.bit(x) for x in labels)).cast("long")
        return F.col("_marks").bitwiseAND(wanted) != 0

    def counts(self, sets: Mapping[str, Column], label: str = "key_set", n: str = "n") -> DataFrame:
        """Distinct keys of each set, a condition made of ``has``; all sets in one pass."""
        names = [f"_s{i}" for i in range(len(sets))]
        totals = self.keys.agg(*[count_where(test).alias(name) for name, test in zip(names, sets.values())])
        return rows_from(totals, [(F.lit(s), F.col(name)) for s, name in zip(sets, names)], (label, n))

    def select(self, test: Column) -> DataFrame:
        """The keys of one set."""
        return self.keys.where(test).drop("_marks")


def top_of_each(counts: DataFrame, value: str, columns: Mapping[str, str], k: int, label: str, n: str) -> DataFrame:
    """The k largest values by each count column: label, value, n; ties to the smaller value.

    One pass: every row becomes a row per column, and Spark keeps k of each within every task
    before the shuffle.
    """
    each = F.array(*[F.struct(F.lit(name).alias(label), F.col(c).alias(n)) for name, c in columns.items()])
    rows = counts.select(value, F.inline(each)).where(F.col(n) > 0)
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(n), value))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).select(label, value, n)
