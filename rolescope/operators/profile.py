"""Profiles, audits and distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.numbers import pct, pct_even, pct_text
from ..functions.text import BROKEN_DASH, NBSP, is_blank, safe_date, unicode_regex
from .totals import as_base, rows_of, top, total_of, with_share


def every(weight: str | None = None) -> Column:
    """Rows; with ``weight`` the rows that each row stands for."""
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0).cast("long"))


def count_where(test: Column, weight: str | None = None) -> Column:
    """Rows for which the test is true; zero, not NULL, over no rows."""
    if weight is None:
        return F.count(F.when(test, F.lit(1)))
    return F.coalesce(F.sum(F.when(test, F.col(weight))), F.lit(0).cast("long"))


def rows_from(df: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turns the one row of ``df`` into several."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


# --- size, coverage -------------------------------------------------------------------


def table_profile(tables: Mapping[str, DataFrame], key: str = "job_link") -> DataFrame:
    """Rows and distinct keys per table."""
    profiles = [
        df.agg(
            F.lit(name).alias("table_name"),
            every().alias("total_rows"),
            F.count_distinct(F.col(key)).alias(f"distinct_{key}s"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, profiles)


def coverage_matrix(
    base: DataFrame, others: Mapping[str, DataFrame], key: str = "job_link", unit: str = "postings"
) -> DataFrame:
    """Base rows with and without a partner in each other table, and with all of them.

    Every table contributes its keys with a mark of origin and one aggregation by key
    brings them together. No side is joined, so no repeated key fans out and a hot key
    is combined before the shuffle.
    """
    marks = [f"_in_{name}" for name in others]

    def marked(df: DataFrame, mark: str | None) -> DataFrame:
        return df.select(
            F.col(key).alias(key),
            F.lit(int(mark is None)).cast("bigint").alias("_rows"),
            *[F.lit(int(m == mark)).alias(m) for m in marks],
        )

    sides = [marked(base, None)]
    sides += [marked(df.filter(F.col(key).isNotNull()), m) for m, df in zip(marks, others.values())]
    per_key = (
        reduce(DataFrame.unionByName, sides)
        .groupBy(key)
        .agg(F.sum("_rows").alias("_rows"), *[F.max(m).alias(m) for m in marks])
        .filter(F.col("_rows") > 0)
    )
    rows = F.col("_rows")
    total = F.coalesce(F.sum(rows), F.lit(0))
    measures = [total.alias(f"total_{unit}")]
    for name, m in zip(others, marks):
        have = F.coalesce(F.sum(rows * F.col(m)), F.lit(0))
        measures += [have.alias(f"{unit}_with_{name}"), (total - have).alias(f"{unit}_without_{name}")]
    all_marks = reduce(lambda a, b: a * b, [F.col(m) for m in marks])
    whole = "both" if len(marks) == 2 else "all"
    measures.append(F.coalesce(F.sum(rows * all_marks), F.lit(0)).alias(f"{unit}_with_{whole}"))
    return per_key.agg(*measures)


def removal_summary(
    before: DataFrame,
    after: DataFrame,
    names: tuple[str, str, str, str] = ("before", "after", "removed", "percentage_removed"),
) -> DataFrame:
    """Rows before and after a step, the difference, and its share."""
    n_before, n_after, n_removed, share = names
    removed = F.col(n_before) - F.col(n_after)
    return (
        before.agg(every().alias(n_before))
        .withColumn(n_after, rows_of(after))
        .withColumn(n_removed, removed)
        .withColumn(share, pct(F.col(n_removed), F.col(n_before)))
    )


# --- distributions --------------------------------------------------------------------


def value_counts(
    df: DataFrame, dim: str | Column, name: str | None = None, n: str = "job_count", weight: str | None = None
) -> DataFrame:
    """Rows per value; NULL is a value."""
    column = F.col(dim) if isinstance(dim, str) else dim
    return df.groupBy(column.alias(name or dim)).agg(every(weight).alias(n))


def distribution(
    df: DataFrame,
    dim: str | Column,
    name: str | None = None,
    n: str = "job_count",
    share: str = "percentage",
    base=None,
) -> DataFrame:
    """Rows per value with the share of the total."""
    return with_share(value_counts(df, dim, name, n), n, share, base)


def rounded_distribution(
    df: DataFrame,
    dim: str,
    n: str = "n",
    share: str = "percentage",
    places: int = 1,
    keep_null: bool = False,
    base=None,
    weight: str | None = None,
) -> DataFrame:
    """Rows per value with a half-even rounded share; NULL values count only on request."""
    counts = value_counts(df if keep_null else df.filter(F.col(dim).isNotNull()), dim, n=n, weight=weight)
    if base is None:
        base = rows_of(df) if weight is None else total_of(df, weight)
    whole = as_base(base)
    return counts.withColumn(share, pct_even(F.col(n), whole, places))


def top_with_groups(
    df: DataFrame,
    dim: str,
    k: int,
    n: str = "job_count",
    share: str = "percentage",
    groups: str = "distinct_values",
) -> DataFrame:
    """The k largest groups with their share and the number of groups."""
    counts = value_counts(df, dim, n=n)
    return top(with_share(counts, n, share).withColumn(groups, rows_of(counts)), k, n, dim)


def rate(
    df: DataFrame,
    flag: str,
    by: str | None = None,
    names: tuple[str, str, str, str] = ("total", "with_flag", "without_flag", "percentage"),
) -> DataFrame:
    """Rows, rows with a 0/1 flag, rows without, and the share, globally or per group."""
    total, have, lack, share = names
    flagged = F.coalesce(F.sum(F.col(flag).cast("bigint")), F.lit(0))
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        every().alias(total),
        flagged.alias(have),
        (every() - flagged).alias(lack),
        pct(flagged, every()).alias(share),
    )


def fragmentation(
    df: DataFrame,
    dim: str | Column,
    names: Sequence[str] = ("total", "distinct_values", "once", "repeated", "rows_once", "percentage_once"),
) -> DataFrame:
    """How many values occur once, how many repeat. NULL is a value."""
    counts = value_counts(df, dim, "_value", "_n")
    total, distinct, once, repeated, rows_once, share = names
    single = count_where(F.col("_n") == 1)
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias(total),
        every().alias(distinct),
        single.alias(once),
        count_where(F.col("_n") > 1).alias(repeated),
        single.alias(rows_once),
        pct(single, every()).alias(share),
    )


# --- audits ---------------------------------------------------------------------------


def missing_audit(
    df: DataFrame,
    col: str,
    names: Sequence[str] = ("total", "missing", "percentage_missing", "distinct_values"),
    null_only: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Rows, rows with a blank or NULL value, their share, distinct values."""
    total, missing, share, distinct = names
    gaps = count_where(F.col(col).isNull() if null_only else is_blank(col), weight)
    return df.agg(
        every(weight).alias(total),
        gaps.alias(missing),
        pct(gaps, every(weight)).alias(share),
        F.count_distinct(F.col(col)).alias(distinct),
    )


def temporal_coverage(
    df: DataFrame,
    col: str,
    names: Sequence[str] = ("total", "valid", "invalid", "earliest", "latest", "distinct_dates"),
    weight: str | None = None,
) -> DataFrame:
    """Valid and invalid dates, first and last date, number of dates."""
    total, valid, invalid, earliest, latest, distinct = names
    # Few dates, many rows: count per date first, so the distinct count costs nothing more.
    day = F.col("_day")
    as_text = isinstance(df.schema[col].dataType, StringType)
    date = safe_date(col) if as_text else F.col(col).cast("date")
    per_day = df.groupBy(date.alias("_day")).agg(every(weight).alias("_n"))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    known = F.coalesce(F.sum(F.when(day.isNotNull(), F.col("_n"))), F.lit(0))
    return per_day.agg(
        rows.alias(total),
        known.alias(valid),
        (rows - known).alias(invalid),
        F.min(day).alias(earliest),
        F.max(day).alias(latest),
        F.count(day).alias(distinct),
    )


def agreement_audit(
    df: DataFrame,
    a: Column,
    b: Column,
    missing_a: Column,
    missing_b: Column,
    names: Sequence[str] = (
        "total", "missing_a", "missing_b", "matching", "nonmatching", "percentage_nonmatching",
    ),
) -> DataFrame:
    """How often two fields agree. A NULL on either side is neither match nor mismatch."""
    total, gaps_a, gaps_b, same, other, share = names
    differ = count_where(a != b)
    return df.agg(
        every().alias(total),
        count_where(missing_a).alias(gaps_a),
        count_where(missing_b).alias(gaps_b),
        count_where(a == b).alias(same),
        differ.alias(other),
        pct(differ, every()).alias(share),
    )


def duplicate_key_audit(df: DataFrame, key: str = "job_link", name: str = "duplicate_keys") -> DataFrame:
    """Rows beyond the first of each key; NULL keys are one group."""
    counts = value_counts(df, key, n="_n")
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def encoding_audit(
    df: DataFrame,
    col: str,
    literals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows containing each literal; by default the non-breaking space and the broken dash."""
    literals = literals or {"nbsp_count": NBSP, "bad_dash_count": BROKEN_DASH}
    return df.agg(*[count_where(F.col(col).contains(x)).alias(name) for name, x in literals.items()])


def pattern_counts(df: DataFrame, col: str, patterns: Mapping[str, str], weight: str | None = None) -> DataFrame:
    """Rows matching each regular expression, in one pass."""
    names = [f"_p{i}" for i in range(len(patterns))]
    counted = df.agg(
        *[count_where(F.col(col).rlike(unicode_regex(p)), weight).alias(n) for n, p in zip(names, patterns.values())]
    )
    return rows_from(counted, [(F.lit(l), F.col(n)) for l, n in zip(patterns, names)], ("pattern", "n"))


def completeness(df: DataFrame, cols: Sequence[str], invalid: Mapping[str, Sequence[str]] | None = None):
    """Populated and missing rows per variable; ``invalid`` values count as missing."""
    invalid = invalid or {}

    def filled(c: str) -> Column:
        column = F.col(c)
        return column.isNotNull() & ~column.isin(*invalid[c]) if c in invalid else column.isNotNull()

    names = [f"_v{i}" for i in range(len(cols))]
    counted = df.agg(every().alias("_all"), *[count_where(filled(c)).alias(n) for c, n in zip(cols, names)])
    total = F.col("_all")
    rows = [(F.lit(c), F.col(n), total - F.col(n), pct_text(F.col(n), total)) for c, n in zip(cols, names)]
    return rows_from(counted, rows, ("variable", "populated", "missing", "complete_pct"))


def distinct_counts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Distinct non-NULL values of several columns."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(name) for name, c in columns.items()])


def group_totals(counts: DataFrame, n: str, total: str, groups: str) -> DataFrame:
    """Sum of the counts and number of groups."""
    return counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias(total), every().alias(groups))


def conditional_share(
    df: DataFrame, by: str, key: str, measures: Mapping[str, tuple[Column, object]]
) -> DataFrame:
    """Distinct keys meeting each condition divided by a base, per group, as doubles."""
    # One row per group and key carrying a flag per measure: the distinct counts become sums.
    names = [f"_m{i}" for i in range(len(measures))]
    tests = [test for test, _ in measures.values()]
    bases = [as_base(base) for _, base in measures.values()]
    per_key = (
        df.filter(F.col(key).isNotNull())
        .groupBy(by, key)
        .agg(*[F.max(F.when(t, 1).otherwise(0)).alias(n) for t, n in zip(tests, names)])
    )
    counts = per_key.groupBy(by).agg(*[F.sum(n).alias(n) for n in names])
    return counts.select(
        by,
        *[
            (F.col(n).cast("double") / F.nullif(b, F.lit(0).cast("bigint"))).alias(label)
            for n, b, label in zip(names, bases, measures)
        ],
    )

