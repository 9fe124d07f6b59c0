"""State of a free-text location."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L
from .text import ColumnLike, as_col, has_word, last_segment, let, text_array


@dataclass(frozen=True)
class StateLookups:
    codes: Sequence[str] = L.STATE_CODES
    names: Mapping[str, str] = field(default_factory=lambda: dict(L.STATE_NAMES))
    district: tuple[str, str] = L.DISTRICT
    other_countries: Sequence[str] = L.OTHER_COUNTRIES
    metros: Mapping[str, str] = field(default_factory=lambda: L.METRO_AREAS | L.METRO_AREAS_ADDED)


DRAFT_LOOKUPS = StateLookups(metros=dict(L.METRO_AREAS))
FULL_LOOKUPS = StateLookups()


def first_named(c: Column, names: Mapping[str, str]) -> Column:
    """Value of the first name, in mapping order, that the text contains."""
    # A CASE with a branch per name would be generated as one method too large for the
    # JIT compiler and run at half the speed of a filter over a constant array.
    found = F.get(F.filter(text_array(names), lambda name: c.contains(name)), F.lit(0))
    return F.try_element_at(F.map_from_arrays(text_array(names), text_array(names.values())), found)


def extract_state(
    location: ColumnLike, lookups: StateLookups = FULL_LOOKUPS, strict: bool = False
) -> Column:
    """State code, ``NON_US``, or NULL.

    Tried in order: code after the last comma, state name, federal district, another
    country, metropolitan area. Names go in mapping order, so "West Virginia" gives VA;
    ``strict`` tries longer names first.
    """
    names = lookups.names
    if strict:
        names = dict(sorted(names.items(), key=lambda item: -len(item[0])))
    district, district_code = lookups.district

    def by_code(last: Column) -> Column:
        return F.when(last.isin(*lookups.codes), last)

    def by_name(lower: Column) -> Column:
        return F.coalesce(
            first_named(lower, names),
            F.when(lower.contains(district), district_code),
            F.when(has_word(lower, *lookups.other_countries), L.NON_US),
            first_named(lower, lookups.metros),
        )

    def state(text: Column) -> Column:
        return F.coalesce(let(last_segment(text), by_code), let(F.lower(text), by_name))

    return let(as_col(location), state)
