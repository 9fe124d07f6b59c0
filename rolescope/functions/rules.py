"""Ordered first-match rules as data, and the expressions built from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L
from .text import ColumnLike, any_of, as_col, contains_any, has_word, let, text_array

UNCATEGORIZED = "Other / Uncategorized"


@dataclass(frozen=True)
class Rule:
    """A label, the substrings and the whole words that select it."""

    label: str
    phrases: tuple[str, ...] = ()
    words: tuple[str, ...] = ()

    def test(self, c: Column) -> Column:
        tests = [contains_any(c, self.phrases)] if self.phrases else []
        if self.words:
            tests.append(has_word(c, *self.words))
        return any_of(tests)


# The role rules, first match wins, tested on the normalised title.
_BUSINESS = Rule(
    L.CORE_ROLE, ("business analyst", "business system analyst", "business process analyst"), ("ba",)
)
_DATA = Rule("Data & Analytics", ("data analyst", "analytics"), ("data",))
_PROJECT = Rule("Project / Program Management", ("project manager", "program manager"))
_IT = Rule(
    "IT / Systems",
    ("systems analyst", "system analyst", "enterprise architect", "software engineer"),
    ("it",),
)
_ENGINEERING = Rule(
    "Engineering / Architecture (other)", words=("engineer", "architect", "developer")
)
_FINANCE_DRAFT = Rule("Finance / Tax", ("tax", "financial analyst", "accounting", "controller"))
_FINANCE = Rule(
    "Finance / Accounting / Tax",
    ("tax", "financial analyst", "accounting", "accountant", "auditor", "underwriter", "controller"),
)
_SALES = Rule("Sales / Business Development", ("sales", "account executive"))
_RETAIL = Rule("Retail / Store", ("store",))
_CONSULTING = Rule("Consulting", ("consultant",))
_MANAGER_DRAFT = Rule("Manager (other)", ("manager",))
_MANAGER = Rule("Manager (other)", ("manager",), ("mgr",))
_ANALYST = Rule("Analyst (other)", words=("analyst",))

ROLE_RULES = {
    "v1": (
        _BUSINESS, _DATA, _PROJECT, _IT, _FINANCE_DRAFT, _RETAIL, _CONSULTING, _MANAGER_DRAFT, _ANALYST,
    ),
    "v2": (_BUSINESS, _DATA, _PROJECT, _IT, _FINANCE_DRAFT, _RETAIL, _CONSULTING, _MANAGER, _ANALYST),
    "final": (
        _BUSINESS, _DATA, _PROJECT, _IT, _ENGINEERING, _FINANCE, _SALES, _RETAIL, _CONSULTING, _MANAGER,
        _ANALYST,
    ),
}


def first_label(c: ColumnLike, rules: Sequence[Rule], otherwise: str | None = None) -> Column:
    """Label of the first rule that holds; ``otherwise`` (default NULL) when none does."""

    def label(text: Column) -> Column:
        head, *tail = rules
        case = F.when(head.test(text), head.label)
        for rule in tail:
            case = case.when(rule.test(text), rule.label)
        return case if otherwise is None else case.otherwise(otherwise)

    # A filter on the label would otherwise repeat the making of the text at every test.
    return let(as_col(c), label)


def classify_role(c: ColumnLike, version: str = "final") -> Column:
    """Role category of a normalised title; a NULL title is uncategorized."""
    return first_label(c, ROLE_RULES[version], UNCATEGORIZED)


def title_family(c: ColumnLike, families=L.TITLE_FAMILIES) -> Column:
    """Label of a related title family, NULL outside the families."""
    return first_label(F.lower(as_col(c)), [Rule(label, phrases) for label, phrases in families])


def role_group(c: ColumnLike, core: str = L.CORE_ROLE) -> Column:
    """Core against other roles; a NULL role counts as other."""
    return F.when(as_col(c) == core, L.CORE_GROUP_LABEL).otherwise(L.OTHER_GROUP_LABEL)


def skill_group(c: ColumnLike, groups=L.SKILL_GROUPS) -> Column:
    """Label of the group listing the skill, NULL outside the groups."""
    c = as_col(c)
    return F.coalesce(*[F.when(c.isin(*skills), label) for label, skills in groups])


def canonical(c: ColumnLike, mapping: dict[str, str] = L.SKILL_SYNONYMS) -> Column:
    """Replaces a whole value by its canonical form; other values stay."""
    c = as_col(c)
    pairs = F.map_from_arrays(text_array(mapping), text_array(mapping.values()))
    return F.coalesce(F.try_element_at(pairs, c), c)
