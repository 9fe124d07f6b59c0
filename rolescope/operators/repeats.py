"""Repeated rows on a composite key. NULL keys form a group of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import pct
from ..functions.text import norm_key
from .profile import count_where, every

POSTING_KEYS = ("job_title", "company", "job_location")


def group_columns(keys: Sequence[str], normalize: bool, digest: bool = False) -> list[Column]:
    """The grouping expressions; ``digest`` groups long texts by their SHA-256."""
    columns = [norm_key(k) if normalize else F.col(k) for k in keys]
    return [F.sha2(c, 256) for c in columns] if digest else columns


def repeat_audit(
    df: DataFrame,
    keys: Sequence[str] = POSTING_KEYS,
    normalize: bool = True,
    digest: bool = False,
    names: Sequence[str] = ("total", "combinations", "repeated", "rows_repeated", "excess", "percentage_repeated"),
) -> DataFrame:
    """Combinations, those occurring more than once, their rows and excess rows."""
    columns = [c.alias(f"_k{i}") for i, c in enumerate(group_columns(keys, normalize, digest))]
    counts = df.groupBy(*columns).agg(every().alias("_n"))
    n = F.col("_n")
    more = n > 1
    rows = F.coalesce(F.sum(n), F.lit(0))
    inside = F.coalesce(F.sum(F.when(more, n)), F.lit(0))
    total, combinations, repeated, in_repeated, excess, share = names
    return counts.agg(
        rows.alias(total),
        every().alias(combinations),
        count_where(more).alias(repeated),
        inside.alias(in_repeated),
        F.coalesce(F.sum(F.when(more, n - 1)), F.lit(0)).alias(excess),
        pct(inside, rows).alias(share),
    )


def flag_repeats(
    df: DataFrame,
    keys: Sequence[str] = POSTING_KEYS,
    normalize: bool = False,
    digest: bool = False,
    name: str = "is_likely_repost",
) -> DataFrame:
    """Marks every row of a group with more than one row.

    The group sizes are aggregated, with a combine before the shuffle, and only the
    repeated groups are joined back. A count over a window would bring a group, however
    large, into one task; here AQE can split a hot group's partition of the join.
    """
    columns = group_columns(keys, normalize, digest)
    names = [f"_k{i}" for i in range(len(keys))]
    as_written = not (normalize or digest)
    # As one struct the key is made once, not at every comparison, and its NULL fields are
    # equal to each other. Keys compared as written travel in the struct only.
    carried = [c for c in df.columns if c not in keys] if as_written else df.columns
    rows = df.select(*carried, F.struct(*[c.alias(n) for c, n in zip(columns, names)]).alias("_group"))
    repeated = (
        df.groupBy(*[c.alias(n) for c, n in zip(columns, names)])
        .agg(every().alias("_n"))
        .filter(F.col("_n") > 1)
        .select(F.struct(*names).alias("_group"), F.lit(True).alias("_repeated"))
    )
    written = dict(zip(keys, names))
    kept = [F.col(c) if c in carried else F.col("_group")[written[c]].alias(c) for c in df.columns]
    return rows.join(repeated, "_group", "left").select(*kept, F.col("_repeated").isNotNull().alias(name))


def keep_first(
    df: DataFrame,
    keys: Sequence[str] = POSTING_KEYS,
    order: Sequence[str] = ("job_link",),
    normalize: bool = True,
    digest: bool = False,
) -> DataFrame:
    """One row per group, the lowest in ``order``.

    ``rank = 1`` lets Spark drop all but one row of each group within every map task
    (WindowGroupLimit), so a hot group reaches the shuffle as one row per task.
    """
    window = Window.partitionBy(*group_columns(keys, normalize, digest)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") == 1).drop("_rank")
