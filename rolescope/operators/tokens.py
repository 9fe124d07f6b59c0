"""Lists inside a text column: splitting, membership, counting."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import ANCHOR_SKILLS
from ..functions.text import ColumnLike, as_col, contains_any, contains_ci, may_have_other_space, holds, trim_text
from .keys import exclude
from .totals import with_share


def _pieces(c: Column, sep: str) -> Column:
    return F.split(c, re.escape(sep))


def split_list(c: ColumnLike, sep: str = ",", unicode_space: bool = False) -> Column:
    """Array of trimmed tokens; empty tokens stay, a NULL list is NULL."""
    return F.transform(_pieces(as_col(c), sep), lambda piece: trim_text(piece, unicode_space))


def explode_list(
    df: DataFrame,
    col: str,
    keep: Sequence[str],
    out: str = "skill_term",
    sep: str = ",",
    fold_case: bool = True,
    unicode_space: bool = False,
    drop_empty: bool = True,
) -> DataFrame:
    """One row per token with the ``keep`` columns only, so wide columns are not repeated."""
    text = F.lower(F.col(col)) if fold_case else F.col(col)
    pieces = _pieces(text, sep)
    if unicode_space:
        # decided once per list: few lists hold white space that trim() below would leave
        pieces = F.when(may_have_other_space(text), split_list(text, sep, True)).otherwise(pieces)
    rows = df.select(*keep, F.explode(pieces).alias(out)).withColumn(out, F.trim(out))
    return rows.filter(F.col(out) != "") if drop_empty else rows


def lists_mentioning(df: DataFrame, col: str, phrases: Sequence[str]) -> DataFrame:
    """Rows whose whole list contains a phrase: the cheap test to make before splitting."""
    return df.filter(contains_ci(col, *phrases))


def has_term(c: ColumnLike, terms: Sequence[str], sep: str = ",", unicode_space: bool = False) -> Column:
    """One of the (lower-case) terms is a whole token of the list. Needs no explode."""

    def listed(lower: Column) -> Column:
        # most lists fail the substring test and are never split
        token = lambda piece: trim_text(piece, unicode_space).isin(*terms)
        return contains_any(lower, terms) & F.exists(_pieces(lower, sep), token)

    return holds(F.lower(as_col(c)), listed)


def term_counts(tokens: DataFrame, term: str = "skill_term", key: str = "job_link", n: str = "job_count"):
    """Distinct keys per term."""
    return tokens.groupBy(term).agg(F.count_distinct(F.col(key)).alias(n))


def compare_definitions(
    tokens: DataFrame,
    definitions: dict[str, Callable[[Column], Column]],
    term: str = "skill_term",
    key: str = "job_link",
    n: str = "job_count",
) -> DataFrame:
    """Distinct keys under each definition of a term, in one pass over the tokens."""
    # One flag per definition and key, so no copy of the rows per distinct count.
    names = [f"_d{i}" for i in range(len(definitions))]
    flagged = tokens.select(
        key, *[test(F.col(term)).cast("int").alias(d) for d, test in zip(names, definitions.values())]
    ).filter(F.greatest(*names) == 1 if len(names) > 1 else F.col(names[0]) == 1)
    per_key = flagged.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(d).alias(d) for d in names])
    totals = per_key.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in names])
    rows = [
        F.struct(F.lit(label).alias("definition"), F.col(d).alias(n)) for d, label in zip(names, definitions)
    ]
    return totals.select(F.inline(F.array(*rows)))


def broad_only(
    tokens: DataFrame,
    broad: Callable[[Column], Column],
    exact: Sequence[str] = ANCHOR_SKILLS,
    term: str = "skill_term",
    key: str = "job_link",
) -> DataFrame:
    """Tokens meeting the broad test, of keys that have none of the exact terms."""
    confirmed = tokens.filter(F.col(term).isin(*exact))
    return exclude(tokens.filter(broad(F.col(term))).select(key, term), confirmed, key)


def complementary_counts(
    tokens: DataFrame,
    base,
    anchors: Sequence[str] = ANCHOR_SKILLS,
    term: str = "skill",
    key: str = "job_link",
    share: str = "percentage",
) -> DataFrame:
    """Distinct keys per term, anchors left out, with the share in ``base``."""
    others = tokens.filter(~F.lower(F.col(term)).isin(*anchors))
    return with_share(term_counts(others, term, key), share=share, base=base)
