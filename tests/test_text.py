import datetime as dt
import re
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolescope.functions import lookups as L
from rolescope.functions import numbers as N
from rolescope.functions import text as X


def test_keys_and_trimming(values):
    assert values(X.norm_key, [" A b ", "x", None]) == ["a b", "x", None]
    assert values(lambda c: X.norm_key(c), ["\tA\u00a0"]) == ["\ta\u00a0"]
    assert values(lambda c: X.norm_key(c, unicode_space=True), ["\tA\u00a0", " b "]) == ["a", "b"]
    assert values(lambda c: X.bounded_key(c, 3), ["abcd", None]) == ["abc", None]
    assert values(X.or_empty, [None, "a"]) == ["", "a"]


def test_strip_space_is_str_strip(values):
    others = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = [f"{c}a{c}b{c}" for c in others] + ["".join(others), "", "x", "  é  "]
    assert values(X.strip_space, texts) == [t.strip() for t in texts]


def test_blank(values):
    assert values(X.is_blank, [None, "", "  ", " a", "\t"]) == [True, True, True, False, False]


def test_dates(values):
    texts = ["2024-01-12", "2024-13-45", "not a date", None]
    assert values(X.safe_date, texts) == [dt.date(2024, 1, 12), None, None, None]
    assert values(lambda c: X.safe_date(c, strict=True), ["2024-01-12"]) == [dt.date(2024, 1, 12)]


def test_segments(values):
    texts = ["New York, NY", "Remote", "a, b, c ", "", None, "x,"]
    assert values(X.first_segment, texts) == ["New York", "Remote", "a", "", None, "x"]
    assert values(X.last_segment, texts) == ["NY", "Remote", "c", "", None, ""]


def test_standalone_token(values):
    hit = lambda c: X.has_token(X.punct_to_space(c), "ba")
    texts = ["Sr. BA/PO", "BAse", None, "BA", "x-ba", "(BA)", "BA,", "ba.x", "b a"]
    assert values(hit, texts) == [True, False, None, True, True, True, True, True, False]


def test_phrases(values):
    assert values(lambda c: X.contains_ci(c, "ab", "cd"), ["xABx", "cD", "a b", None]) == [True, True, False, None]
    assert values(lambda c: X.excludes_ci(c, "ab"), ["xABx", "c", None]) == [False, True, None]
    assert values(lambda c: X.has_any_phrase([c], L.EVIDENCE_PHRASES), ["User Stories", "none", None]) == [1, 0, 0]
    assert values(lambda c: X.like_ci(c, "%business%analyst%"), ["Business Data Analyst", "Analyst, Business"]) == [
        True,
        False,
    ]


def test_encoding(values):
    assert values(X.replace_nbsp, ["a\u00a0b", "a b", None]) == ["a b", "a b", None]


def reference_title(title):
    t = re.sub(r"[.,]", "", title.lower())
    for pattern, word in L.TITLE_WORD_RULES:
        t = re.sub(pattern, word, t)
    return re.sub(r"\s+", " ", t.strip())


def test_title_normalizer(values):
    texts = [
        "  Sr. Business  Systems Analyst, Jr. ", "Ecosystems", "SYSTEM", "é sr", "srs sr", "a\u00a0\tb", "", "sr.jr",
        "Sr-Jr/Systems", "café-sr", "ésr", "sr_x",
    ]
    assert values(X.normalize_title, texts) == [reference_title(t) for t in texts]
    assert values(X.normalize_title, [None]) == [None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("sr jr.,SYSTEMsystem \u00a0é-/\n\t", max_size=25), min_size=1, max_size=40))
def test_title_normalizer_on_random_titles(spark, titles):
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    for raw, mine in rows.select("t", X.normalize_title("t")).collect():
        assert mine == reference_title(raw)


def test_percentages(spark):
    rows = spark.createDataFrame([(1, 800), (1, 8), (0, 0), (201, 20000), (7, 7)], "n bigint, d bigint")
    got = [r[0] for r in rows.select(N.pct(F.col("n"), F.col("d"))).collect()]
    assert got == [Decimal("0.13"), Decimal("12.50"), None, Decimal("1.01"), Decimal("100.00")]


def test_rounding_is_numpy_rounding(spark):
    import numpy as np

    pairs = [(n, d) for d in (3, 7, 8, 40, 800, 1564, 8610) for n in range(0, d, max(1, d // 60))]
    rows = spark.createDataFrame(pairs, "n bigint, d bigint")
    for places in (1, 2):
        got = [r[0] for r in rows.select(N.pct_even(F.col("n"), F.col("d"), places)).collect()]
        assert got == [float(np.round(100 * n / d, places)) for n, d in pairs]


def test_percent_text(spark):
    rows = spark.createDataFrame([(1, 3), (2, 2), (0, 5)], "n bigint, d bigint")
    assert [r[0] for r in rows.select(N.pct_text(F.col("n"), F.col("d"))).collect()] == ["33.33%", "100.00%", "0.00%"]
