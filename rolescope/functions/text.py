"""Text expressions. Every function takes a column (or its name) and returns a Column."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import TITLE_WORD_RULES

NBSP = "\u00a0"
BROKEN_DASH = "â€"
# What str.strip() takes for white space, besides the blank.
_OTHER_SPACE = (
    r"\t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
_EDGES = f"^[ {_OTHER_SPACE}]+|[ {_OTHER_SPACE}]+$"

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(tests: Iterable[Column]) -> Column:
    """True if any test is; no test at all is false."""
    return reduce(or_, tests, F.lit(False))


def text_array(values: Iterable[str]) -> Column:
    """A constant array; Spark folds it before execution."""
    values = list(values)
    if not values or any("\n" in v for v in values):
        return F.array(*map(F.lit, values)).cast("array<string>")
    return F.split(F.lit("\n".join(values)), "\n")


def holds(value: Column, test: Callable[[Column], Column]) -> Column:
    """A test that mentions its value several times while the value is computed once.

    In a filter Spark computes an expression at every mention, and it puts the definition
    of a derived column in place of its name. A lambda variable is computed once: eight
    phrase tests on long lower-cased text take two thirds of the time.
    """
    return F.exists(F.array(value), test)


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """Like ``holds`` for an expression of any type."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def may_have_other_space(c: ColumnLike) -> Column:
    """False only when blanks are the only white space: plain ASCII without control characters."""
    c = as_col(c)
    return (F.octet_length(c) != F.char_length(c)) | c.rlike(r"[\x09-\x0d\x1c-\x1f]")


def strip_space(c: ColumnLike) -> Column:
    """Trim every kind of white space; ``trim`` alone strips blanks only."""
    def strip(t: Column) -> Column:
        # most texts are spared the slower replacement
        return F.when(may_have_other_space(t), F.regexp_replace(t, _EDGES, "")).otherwise(F.trim(t))

    return let(as_col(c), strip)


def trim_text(c: ColumnLike, unicode_space: bool = False) -> Column:
    return strip_space(c) if unicode_space else F.trim(as_col(c))


def norm_key(c: ColumnLike, unicode_space: bool = False) -> Column:
    """Trimmed, lower-cased comparison key."""
    return F.lower(trim_text(c, unicode_space))


def bounded_key(c: ColumnLike, n: int = 2000) -> Column:
    """A key cut to a bounded length."""
    return F.left(as_col(c), F.lit(n))


def text_preview(c: ColumnLike, n: int) -> Column:
    return F.left(as_col(c), F.lit(n))


def or_empty(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def is_blank(c: ColumnLike) -> Column:
    """NULL, or nothing but blanks."""
    c = as_col(c)
    return c.isNull() | (F.trim(c) == "")


def safe_date(c: ColumnLike, strict: bool = False) -> Column:
    """Text to date. Bad text gives NULL, or an error when ``strict``."""
    return F.to_date(as_col(c)) if strict else F.try_to_date(as_col(c))


def first_segment(c: ColumnLike, sep: str = ",") -> Column:
    """Text before the first separator, untrimmed; the whole text without one."""
    return F.substring_index(as_col(c), sep, 1)


def last_segment(c: ColumnLike, sep: str = ",") -> Column:
    """Trimmed text after the last separator."""
    return strip_space(F.substring_index(as_col(c), sep, -1))


def punct_to_space(c: ColumnLike, marks: str = "-/(),.") -> Column:
    return F.lower(F.translate(as_col(c), marks, " " * len(marks)))


def has_token(c: ColumnLike, token: str) -> Column:
    """The token stands alone between blanks; NULL text gives NULL."""
    return F.concat(F.lit(" "), as_col(c), F.lit(" ")).contains(f" {token} ")


def contains_any(c: ColumnLike, phrases: Sequence[str]) -> Column:
    """Case-sensitive substring test."""
    c = as_col(c)
    return any_of(c.contains(p) for p in phrases)


def contains_ci(c: ColumnLike, *phrases: str) -> Column:
    """Substring test ignoring case; the phrases are lower case."""
    lower = F.lower(as_col(c))
    if len(phrases) == 1:
        return lower.contains(phrases[0])
    return holds(lower, lambda t: contains_any(t, phrases))


def excludes_ci(c: ColumnLike, *phrases: str) -> Column:
    """No phrase occurs. NULL text gives NULL, so a filter drops it."""
    return ~contains_ci(c, *phrases)


def like_ci(c: ColumnLike, pattern: str) -> Column:
    return F.lower(as_col(c)).like(pattern)


def has_any_phrase(cols: Sequence[ColumnLike], phrases: Sequence[str]) -> Column:
    """1 when a phrase occurs in one of the columns, else 0."""
    return any_of(contains_ci(or_empty(c), *phrases) for c in cols).cast("int")


def has_word(c: ColumnLike, *words: str) -> Column:
    """One of the words occurs between word boundaries."""
    c = as_col(c)
    pattern = "|".join(re.escape(w) for w in words)
    # the substring test is cheap and spares most rows the regular expression
    return contains_any(c, words) & c.rlike(rf"(?U)\b(?:{pattern})\b")


def unicode_regex(pattern: str) -> str:
    r"""Makes ``\b``, ``\w`` and ``\s`` follow Unicode, as Python's ``re`` does on str."""
    return f"(?U){pattern}"


def replace_nbsp(c: ColumnLike) -> Column:
    return F.translate(as_col(c), NBSP, " ")


def normalize_title(c: ColumnLike, word_rules: Sequence[tuple[str, str]] = TITLE_WORD_RULES) -> Column:
    """Lower-case, drop ``.`` and ``,``, unify the given words, tidy white space."""
    title = F.translate(F.lower(as_col(c)), ".,", "")
    for pattern, word in word_rules:
        title = F.regexp_replace(title, unicode_regex(pattern), word)
    return F.trim(F.regexp_replace(title, f"[ {_OTHER_SPACE}]+", " "))


def fold(c: ColumnLike) -> Column:
    return F.lower(as_col(c))
