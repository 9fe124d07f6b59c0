"""Word lists and lookup tables.

Everything in this module is a fixed value: results are only right when the lists
(and, where noted, their order) are exactly these.
"""

# The skill terms that put an advert into the target population.
ANCHOR_SKILLS = ("business analysis", "business analyst")

# Title phrases of the target population.
TITLE_PHRASES = ("business analyst",)
TITLE_EXCLUSIONS = ("business analytics",)
FAMILY_PHRASES = (
    "business systems analyst",
    "business system analyst",
    "business process analyst",
)

# Labels of the two related title families, first match wins.
TITLE_FAMILIES = (
    ("Business System(s) Analyst", ("business systems analyst", "business system analyst")),
    ("Business Process Analyst", ("business process analyst",)),
)

# Phrases that count as evidence of the activity.
EVIDENCE_PHRASES = (
    "requirements",
    "stakeholder",
    "process analysis",
    "process improvement",
    "process mapping",
    "user stories",
    "gap analysis",
    "functional requirements",
)

# Word replacements of the title normaliser, applied in this order.
TITLE_WORD_RULES = (
    (r"\bsr\b", "senior"),
    (r"\bjr\b", "junior"),
    (r"\bsystems?\b", "system"),
)

# Patterns counted among the titles left without a role.
LEFTOVER_PATTERNS = {
    "engineer/architect/developer": r"\b(engineer|architect|developer)\b",
    "accountant/auditor/underwriter": r"\b(accountant|auditor|underwriter)\b",
    "human resources / hr": r"human resources|\bhr\b",
    "sales / account executive": r"\bsales\b|account executive",
    "scrum master/agile lead": r"scrum master",
}

# Skill synonyms, whole-token match.
SKILL_SYNONYMS = {
    "problemsolving": "problem solving",
    "problemsolving skills": "problem solving",
    "communication skills": "communication",
    "written communication": "communication",
    "verbal communication": "communication",
    "microsoft office suite": "microsoft office",
    "agile development": "agile",
    "analytical thinking": "analytical skills",
    "team leadership": "leadership",
    "stakeholder engagement": "stakeholder management",
}

# The skills of the share view and its two skill groups.
SHARE_SKILLS = (
    "communication",
    "problem solving",
    "project management",
    "data analysis",
    "analytical skills",
    "sql",
    "leadership",
    "teamwork",
    "agile",
    "microsoft office",
    "requirements gathering",
    "documentation",
    "jira",
)
SKILL_GROUPS = (
    ("A  Overall-frequency skills", ("communication", "problem solving", "leadership")),
    ("B  Core-BA practice skills", ("requirements gathering", "documentation", "jira")),
)
CORE_ROLE = "Business Analysis"
CORE_GROUP_LABEL = "Core Business Analysis"
OTHER_GROUP_LABEL = "Other BA-related roles"
ALL_GROUP_LABEL = "All BA-related"

# State codes (50 states and DC), matched case-sensitively.
STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
)

# State names, tried in this order.
STATE_NAMES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT",
    "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}

# The federal district, and the value for adverts outside the country.
DISTRICT = ("district of columbia", "DC")
OTHER_COUNTRIES = ("canada", "mexico", "turkey")
NON_US = "NON_US"

# Metropolitan areas, tried in this order.
METRO_AREAS = {
    "san francisco bay area": "CA",
    "greater houston": "TX",
    "atlanta metropolitan area": "GA",
    "greater minneapolis-st. paul area": "MN",
    "greater milwaukee": "WI",
    "greater cleveland": "OH",
    "dallas-fort worth metroplex": "TX",
    "greater philadelphia": "PA",
    "miami-fort lauderdale area": "FL",
    "nashville metropolitan area": "TN",
    "killeen-temple area": "TX",
    "greater tuscaloosa area": "AL",
    "louisville metropolitan area": "KY",
    "topeka metropolitan area": "KS",
    "greater pittsburgh region": "PA",
    "memphis metropolitan area": "TN",
    "buffalo-niagara falls area": "NY",
    "greater richmond region": "VA",
    "greater sacramento": "CA",
    "greater rockford area": "IL",
    "charlotte metro": "NC",
    "cincinnati metropolitan area": "OH",
    "greater st. louis": "MO",
    "knoxville metropolitan area": "TN",
    "greater madison area": "WI",
    "greater wilmington area": "DE",
    "baton rouge metropolitan area": "LA",
    "los angeles metropolitan area": "CA",
    "brownsville metropolitan area": "TX",
    "greater chicago area": "IL",
    "erie-meadville area": "PA",
    "des moines metropolitan area": "IA",
    "bellingham metropolitan area": "WA",
    "greater savannah area": "GA",
    "greater boston": "MA",
    "greater jacksonville, nc area": "NC",
    "pueblo-cañon city area": "CO",
}
METRO_AREAS_ADDED = {
    "utica-rome area": "NY",
    "greater phoenix area": "AZ",
    "greater reno area": "NV",
    "greater syracuse-auburn area": "NY",
    "greater orlando": "FL",
    "greater macon": "GA",
    "greater anchorage area": "AK",
    "tallahassee metropolitan area": "FL",
    "salt lake city metropolitan area": "UT",
    "greater tampa bay area": "FL",
}
