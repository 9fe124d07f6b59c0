import re

from rolescope.functions import lookups as L
from rolescope.functions import rules as R
from rolescope.functions.geo import DRAFT_LOOKUPS, extract_state
from rolescope.plans.cohort import CLEANING, STANDARD, any_title_test, family_test, skill_test, title_test


def test_final_roles(values):
    expected = {
        "senior business analyst": "Business Analysis",
        "program manager/ba (remote)": "Business Analysis",
        "base operator": "Other / Uncategorized",
        "data entry clerk": "Data & Analytics",
        "database clerk": "Other / Uncategorized",
        "it project manager": "Project / Program Management",
        "ecosystems analyst": "IT / Systems",
        "head of it": "IT / Systems",
        "cloud architect": "Engineering / Architecture (other)",
        "enterprise architect": "IT / Systems",
        "senior accountant": "Finance / Accounting / Tax",
        "salesforce consultant": "Sales / Business Development",
        "store mgr": "Retail / Store",
        "consultant": "Consulting",
        "office mgr": "Manager (other)",
        "pricing analyst": "Analyst (other)",
        "analysts": "Other / Uncategorized",
        "": "Other / Uncategorized",
        None: "Other / Uncategorized",
    }
    assert values(lambda c: R.classify_role(c), list(expected)) == list(expected.values())


def test_draft_roles(values):
    titles = ["office mgr", "software developer", "accountant", "account executive", "tax clerk"]
    assert values(lambda c: R.classify_role(c, "v1"), titles) == ["Other / Uncategorized"] * 4 + ["Finance / Tax"]
    assert values(lambda c: R.classify_role(c, "v2"), titles)[0] == "Manager (other)"


def test_families_and_groups(values):
    titles = ["Sr Business Systems Analyst", "business process analyst", "Business Analyst", None]
    assert values(R.title_family, titles) == ["Business System(s) Analyst", "Business Process Analyst", None, None]
    assert values(R.role_group, ["Business Analysis", "Consulting", None]) == [
        "Core Business Analysis", "Other BA-related roles", "Other BA-related roles",
    ]
    assert [g and g[0] for g in values(R.skill_group, ["leadership", "jira", "sql", None])] == ["A", "B", None, None]


def test_synonyms(values):
    assert values(R.canonical, ["team leadership", "leadership", "x", None]) == ["leadership", "leadership", "x", None]


def test_title_rules(values):
    titles = ["Business Analyst", "Business Analyst, Business Analytics", "Business Process Analyst", None]
    assert values(lambda c: title_test(c, STANDARD), titles) == [True, False, False, False]
    assert values(lambda c: title_test(c, CLEANING), titles) == [True, True, False, False]
    assert values(family_test, titles) == [False, False, True, False]
    assert values(any_title_test, titles) == [True, False, True, False]


def test_skill_rule(values):
    lists = [
        "SQL, Business Analysis ,x", "business analyst", "Senior Business Analyst", None, "", ",,",
        "Business Analysis\u00a0,x", "x,\tbusiness analyst",
    ]
    assert values(skill_test, lists) == [True, True, False, None, False, False, False, False]
    assert values(lambda c: skill_test(c, CLEANING), lists) == [True, True, False, None, False, False, True, True]


def reference_state(location, metros):
    last, lower = location.split(",")[-1].strip(), location.lower()
    if last in L.STATE_CODES:
        return last
    tries = [(n, v) for n, v in L.STATE_NAMES.items()] + [L.DISTRICT]
    found = [v for n, v in tries if n in lower]
    if not found and any(re.search(rf"\b{c}\b", lower) for c in L.OTHER_COUNTRIES):
        found = [L.NON_US]
    found += [v for n, v in metros.items() if n in lower]
    return found[0] if found else None


LOCATIONS = [
    "Austin, TX", "austin, tx", " Boston, MA ", "Charleston, West Virginia, United States", "Washington, DC",
    "Washington DC-Baltimore Area", "Washington, District of Columbia, United States", "District of Columbia",
    "Little Rock, Arkansas", "Kansas City Metropolitan Area", "New Mexico", "Mexico City, Mexico", "Mexicos",
    "Toronto, Canada", "Greater Jacksonville, NC Area", "Pueblo-Cañon City Area", "Greater Tampa Bay Area",
    "Greater Minneapolis-St. Paul Area", "United States", "", "   ", "Remote", "x,\u00a0TX",
] + [n.title() for n in L.STATE_NAMES] + [m.title() for m in L.METRO_AREAS | L.METRO_AREAS_ADDED]


def test_states(values):
    full = L.METRO_AREAS | L.METRO_AREAS_ADDED
    assert values(extract_state, LOCATIONS) == [reference_state(x, full) for x in LOCATIONS]
    draft = lambda c: extract_state(c, DRAFT_LOOKUPS)
    assert values(draft, LOCATIONS) == [reference_state(x, L.METRO_AREAS) for x in LOCATIONS]
    assert values(extract_state, [None]) == [None]


def test_state_order(values):
    places = ["Charleston, West Virginia, United States", "Washington, District of Columbia"]
    assert values(extract_state, places) == ["VA", "WA"]
    assert values(lambda c: extract_state(c, strict=True), places) == ["WV", "WA"]
