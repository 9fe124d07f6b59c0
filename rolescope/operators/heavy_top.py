"""Top lists over columns of very many values, without a shuffle of all values where that can be proved right.

A frequent-items sketch names candidates in one pass, and only they are counted exactly. A
value that is no candidate has at most 7 / ``tracked`` of the rows. If the last value of the list
has more, no other can belong to it; else all values are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import value_counts
from .skew import TRACKED, likely_heavy
from .tokens import term_counts
from .totals import top


def _proved(df: DataFrame, col: str, k: int, counted, n: str, tracked: int) -> DataFrame | None:
    candidates = likely_heavy(df, col, most=tracked, tracked=tracked)
    if len(candidates) < k:
        return None
    best = top(counted(df.where(F.col(col).isin(candidates))), k, n, col)
    found = best.collect()  # k rows
    beyond = 7 * df.where(F.col(col).isNotNull()).count() / tracked
    # NULL is no candidate, and may be a value of the list
    if len(found) < k or found[-1][n] <= beyond:
        return None
    return best


def top_values(df: DataFrame, col: str, k: int, n: str = "job_count", tracked: int = TRACKED) -> tuple[DataFrame, bool]:
    """The k most frequent values but NULL, ties to the smaller one; and whether the sketch was enough."""
    known = df.where(F.col(col).isNotNull()).select(col)
    counted = lambda rows: value_counts(rows, col, n=n)
    best = _proved(known, col, k, counted, n, tracked)
    return (top(counted(known), k, n, col), False) if best is None else (best, True)


def top_terms(
    tokens: DataFrame, k: int, term: str = "skill_term", key: str = "job_link", n: str = "job_count", tracked: int = TRACKED
) -> tuple[DataFrame, bool]:
    """The same for distinct keys per term: a term has at least as many rows as keys, so the proof holds."""
    known = tokens.where(F.col(term).isNotNull()).select(term, key)
    counted = lambda rows: term_counts(rows, term, key, n)
    best = _proved(known, term, k, counted, n, tracked)
    return (top(counted(known), k, n, term), False) if best is None else (best, True)
