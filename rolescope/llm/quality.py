"""Quality rules: a table of thresholds compiled into one projection of ratios.

Every rule bounds a ratio of two counts of a text. All counts are Spark expressions; a rule
compares integers, so no rounding decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it was for on be with by as are this not or "
    "der die und das den von zu mit ist des im dem nicht ein eine als auch für "
    "de la le les et des un une est que en pour dans qui sur pas au du "
    "el los las y del se por con para una su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Holds where ``low <= 1000 * part / whole <= high``; an open side is None. ``whole`` 0 fails."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        part, whole = 1000 * F.col(self.part), F.col(self.whole)
        test = whole > 0
        if self.low is not None:
            test &= part >= self.low * whole
        if self.high is not None:
            test &= part <= self.high * whole
        return test


RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbols", "n_symbols", "n_words", high=200),
    Rule("stop_words", "n_stop_words", "n_words", low=30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=500),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=300),
    Rule("capitals", "n_capitals", "word_chars", high=400),
)


def word_list(text: Column) -> Column:
    """The words of a text: none for null. Splitting at one plain blank is Spark's fast case."""
    blanks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(blanks, " "), "")


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, the first time included."""
    places = F.when(F.size(words) > 2, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(ranked: Column) -> Column:
        same = lambda i, j: F.get(ranked, i)["h"].eqNullSafe(F.get(ranked, j)["h"])
        again = F.filter(ranked, lambda x, i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.sequence(x["i"], x["i"] + 2)))))

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, covered))

    return let(hashes, count)


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts the rules use. A null text counts as an empty one."""
    text = F.coalesce("text", F.lit(""))
    words = word_list(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def of_words(w: Column) -> Column:
        stop = F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(stop).cast("long").alias("n_stop_words"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        cut = F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(cut).cast("long").alias("n_cut_lines"),
        )

    counted = docs.withColumn("_w", let(words, of_words)).withColumn("_l", let(lines, of_lines))
    return counted.select(
        *docs.columns,
        "_w.*",
        "_l.*",
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, kept, failed (names of the rules that do not hold).

    A text with fewer than 50 words, or with more than half of its words in repeated
    3-word windows, fails the base; then no rule is asked. Every row is judged by itself,
    whatever other columns, nulls or copies the table holds.
    """
    counted = measures(docs.select("doc_id", "text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(
        F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    out = counted.withColumn("base_failed", base).withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("text")
