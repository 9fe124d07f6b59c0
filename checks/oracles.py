"""For each registered query the same result as DuckDB SQL over the same tables.

Written from the definitions, not from the DataFrame code: windows where the library
aggregates, outer joins where it uses key sets, one branch per definition where it makes
one pass.
"""

from __future__ import annotations

from rolescope.functions import lookups as L
from rolescope.functions.rules import ROLE_RULES, UNCATEGORIZED

from .adverts import ADVERTS_SQL, sql_text


def pct(part: str, whole: str) -> str:
    """Percentage to two decimals, half-up, in integers."""
    return f"(CASE WHEN ({whole}) > 0 THEN ((20000 * ({part}) + ({whole})) // (2 * ({whole}))) / 100.0 END)"


def pct_even(part: str, whole: str, places: int) -> str:
    scale = float(10**places)
    return f"(round_even(100.0 * ({part}) / CAST(({whole}) AS DOUBLE) * {scale}, 0) / {scale})"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def n_if(test: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"


def quoted(values) -> str:
    return ", ".join(map(sql_text, values))


def mentions(phrases, col: str = "job_title") -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {sql_text(p)})" for p in phrases) + ")"


TITLED_TEST, EXCLUDED_TEST, FAMILY_TEST = map(mentions, (L.TITLE_PHRASES, L.TITLE_EXCLUSIONS, L.FAMILY_PHRASES))
TRIM = "trim({0}, ' ')"
KEY3 = ", ".join(f"lower(trim({c}, ' '))" for c in ("job_title", "company", "job_location"))
STRIP = r"regexp_replace({0}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"
ANCHORS = quoted(L.ANCHOR_SKILLS)
BROAD_TERM = f"{mentions(L.ANCHOR_SKILLS, 'skill_term')} AND NOT {mentions(L.TITLE_EXCLUSIONS, 'skill_term')}"

TOKENS = """
pieces AS (SELECT job_link, unnest(string_split(job_skills, ',')) AS piece FROM job_skills),
tokens AS (SELECT job_link, lower(trim(piece, ' ')) AS skill_term FROM pieces)
"""
COHORT = f"""{ADVERTS_SQL}, {TOKENS},
skill_keys AS (SELECT DISTINCT job_link FROM tokens WHERE skill_term IN ({ANCHORS})),
titled AS (SELECT * FROM postings WHERE {TITLED_TEST} AND NOT {EXCLUDED_TEST}),
family AS (SELECT * FROM postings WHERE {FAMILY_TEST}),
cohort AS (SELECT job_link FROM skill_keys UNION SELECT job_link FROM titled UNION SELECT job_link FROM family),
us AS (SELECT p.* FROM cohort r JOIN postings p ON r.job_link = p.job_link WHERE search_country = 'United States')
"""

# the cleaning job: other title rule, every kind of white space trimmed
CLEAN_COHORT = f"""{ADVERTS_SQL},
pieces AS (SELECT job_link, unnest(string_split(job_skills, ',')) AS piece FROM job_skills),
skill_keys AS (SELECT DISTINCT job_link FROM pieces WHERE lower({STRIP.format('piece')}) IN ({ANCHORS})),
titled AS (SELECT DISTINCT job_link FROM postings WHERE {TITLED_TEST}),
families AS (SELECT DISTINCT job_link FROM postings WHERE {FAMILY_TEST}),
members AS (SELECT job_link FROM skill_keys UNION SELECT job_link FROM titled UNION SELECT job_link FROM families),
us AS (SELECT p.* FROM postings p WHERE p.job_link IN (SELECT job_link FROM members)
  AND search_country = 'United States'),
combined AS (SELECT us.* EXCLUDE (search_country), job_skills FROM us LEFT JOIN job_skills USING (job_link))
"""


def normalized(col: str) -> str:
    out = f"regexp_replace(lower({col}), '[.,]', '', 'g')"
    for pattern, word in L.TITLE_WORD_RULES:
        out = f"regexp_replace({out}, {sql_text(pattern)}, {sql_text(word)}, 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'), ' ')"


def role_case(version: str, t: str = "job_title_normalized") -> str:
    def test(rule) -> str:
        tests = [f"strpos({t}, {sql_text(p)}) > 0" for p in rule.phrases]
        if rule.words:
            tests.append(rf"regexp_matches({t}, '\b({'|'.join(rule.words)})\b')")
        return " OR ".join(tests)

    whens = " ".join(f"WHEN {test(r)} THEN {sql_text(r.label)}" for r in ROLE_RULES[version])
    return f"CASE {whens} ELSE {sql_text(UNCATEGORIZED)} END"


def state_case(loc: str = "job_location", metros=None, longest_first: bool = False) -> str:
    metros = L.METRO_AREAS | L.METRO_AREAS_ADDED if metros is None else metros
    names = list(L.STATE_NAMES.items())
    if longest_first:
        names.sort(key=lambda item: -len(item[0]))
    last = f"trim(string_split({loc}, ',')[-1], ' ')"
    whens = [f"WHEN {last} IN ({quoted(L.STATE_CODES)}) THEN {last}"]
    whens += [f"WHEN contains(lower({loc}), {sql_text(k)}) THEN '{v}'" for k, v in names]
    whens.append(f"WHEN contains(lower({loc}), 'district of columbia') THEN 'DC'")
    whens.append(rf"WHEN regexp_matches(lower({loc}), '\b(canada|mexico|turkey)\b') THEN 'NON_US'")
    whens += [f"WHEN contains(lower({loc}), {sql_text(k)}) THEN '{v}'" for k, v in metros.items()]
    return f"CASE {' '.join(whens)} END"


LAST_PART = "trim(string_split(job_location, ',')[-1], ' ')"
TITLED = f"""{CLEAN_COHORT},
mended AS (SELECT * REPLACE (replace(job_title, chr(160), ' ') AS job_title) FROM us),
titles AS (SELECT *, {normalized('job_title')} AS job_title_normalized FROM mended)
"""
CLEANED = f"""{CLEAN_COHORT},
flagged AS (SELECT *, count(*) OVER (PARTITION BY job_title, company, job_location) > 1 AS is_likely_repost
  FROM combined),
mended AS (SELECT * REPLACE (replace(job_title, chr(160), ' ') AS job_title) FROM flagged),
titles AS (SELECT *, {normalized('job_title')} AS job_title_normalized FROM mended),
cleaned AS (SELECT *, {role_case('final')} AS role_category, {state_case()} AS state FROM titles),
skill_rows AS (SELECT job_link, {STRIP.format('unnest(string_split(job_skills, chr(44)))')} AS job_skills FROM combined),
mart AS (SELECT job_link, job_skills,
    CASE lower(job_skills) {' '.join(f"WHEN {sql_text(a)} THEN {sql_text(b)}" for a, b in L.SKILL_SYNONYMS.items())}
      ELSE lower(job_skills) END AS job_skills_normalized
  FROM skill_rows WHERE job_skills <> '')
"""
LOCATED = f"""{CLEAN_COHORT}, located AS (SELECT *, {state_case()} AS state FROM us)"""


def missed(rows: str) -> str:
    """Rows of a sub-query without an anchor skill, through an outer join."""
    return f"(SELECT x.* FROM ({rows}) x LEFT JOIN skill_keys s ON x.job_link = s.job_link WHERE s.job_link IS NULL)"


FAMILY_CASE = " ".join(f"WHEN {mentions(phrases)} THEN {sql_text(label)}" for label, phrases in L.TITLE_FAMILIES)
FAMILY_ROWS = missed(f"""SELECT *, CASE {FAMILY_CASE} END AS candidate_title_family
  FROM family WHERE NOT {TITLED_TEST}""")
ACRONYM_ROWS = missed(rf"""SELECT * FROM postings
  WHERE list_contains(regexp_split_to_array(lower(job_title), '[-/(),. ]'), 'ba')
    AND NOT {TITLED_TEST} AND NOT {FAMILY_TEST}""")


def evidence(rows: str) -> str:
    tests = [mentions(L.EVIDENCE_PHRASES, f"coalesce({c}, '')") for c in ("js.job_skills", "j.job_summary")]
    return f"""(SELECT c.*, CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END AS hit FROM {rows} c
  LEFT JOIN job_skills js ON c.job_link = js.job_link LEFT JOIN job_summary j ON c.job_link = j.job_link)"""


EVIDENCE_COLUMNS = f"""{n('sum(hit)')} AS jobs_with_ba_evidence, {n('count(*) - sum(hit)')} AS jobs_without_ba_evidence,
  {pct('sum(hit)', 'count(*)')} AS percentage_with_ba_evidence"""


def title_counts(rows: str) -> str:
    return f"""SELECT {TRIM.format('job_title')} AS job_title, count(*) AS job_count FROM {rows}
  GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 100"""


def shares(rows: str, dim: str, name: str, share: str, tail: str = "") -> str:
    return f"""SELECT {dim} AS {name}, count(*) AS job_count,
  {pct('count(*)', n('sum(count(*)) OVER ()'))} AS {share} FROM {rows} GROUP BY 1 {tail}"""


def top_tail(name: str, k: int) -> str:
    return f"ORDER BY job_count DESC, {name} NULLS FIRST LIMIT {k}"


def raw_skills(rows: str, share: str, k: int, name: str = "skill", lead: str = "") -> str:
    return f"""SELECT {lead} trim(piece, ' ') AS {name}, count(DISTINCT job_link) AS job_count,
  {pct('count(DISTINCT job_link)', f'SELECT count(*) FROM {rows}')} AS {share}
  FROM {rows} JOIN pieces USING (job_link)
  WHERE trim(piece, ' ') <> '' AND lower(trim(piece, ' ')) NOT IN ({ANCHORS})
  GROUP BY trim(piece, ' ') ORDER BY job_count DESC, {name} LIMIT {k}"""


REDUCED = f"""{COHORT},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY3} ORDER BY job_link) AS rn FROM us),
reduced AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)
"""


def both(one) -> str:
    return f"(SELECT 'Original' AS population, * FROM ({one('us')})) UNION ALL (SELECT 'Sensitivity' AS population, * FROM ({one('reduced')}))"


def top_values(dim: str) -> str:
    return both(lambda rows: shares(rows, dim, "value", "percentage", top_tail("value", 10)))


def role_shares(version: str) -> str:
    return f"""WITH {TITLED}, roles AS (SELECT {role_case(version)} AS role_category FROM titles)
SELECT role_category, count(*) AS job_count,
  {pct_even('count(*)', 'SELECT count(*) FROM roles', 1)} AS percentage FROM roles GROUP BY 1"""


def uncategorized(version: str) -> str:
    return f"""{TITLED}, roles AS (SELECT *, {role_case(version)} AS role_category FROM titles),
leftovers AS (SELECT * FROM roles WHERE role_category = 'Other / Uncategorized')"""


def fragmentation(rows: str, dim: str, names) -> str:
    total, distinct, once, repeated, rows_once, share = names
    return f"""SELECT {n('sum(c)')} AS {total}, count(*) AS {distinct}, {n_if('c = 1')} AS {once},
  {n_if('c > 1')} AS {repeated}, {n_if('c = 1')} AS {rows_once},
  {pct(n_if('c = 1'), 'count(*)')} AS {share}
FROM (SELECT {dim} AS v, count(*) AS c FROM {rows} GROUP BY 1)"""


def repeats(rows: str, keys: str, names) -> str:
    total, combos, repeated, inside, excess, share = names
    more = n("coalesce(sum(c) FILTER (WHERE c > 1), 0)")
    return f"""SELECT {n('sum(c)')} AS {total}, count(*) AS {combos}, {n_if('c > 1')} AS {repeated},
  {more} AS {inside}, {n('coalesce(sum(c - 1) FILTER (WHERE c > 1), 0)')} AS {excess},
  {pct(more, n('sum(c)'))} AS {share}
FROM (SELECT {keys}, count(*) AS c FROM {rows} GROUP BY {keys})"""


def dates(rows: str, expr: str, names) -> str:
    total, valid, invalid, earliest, latest, distinct = names
    return f"""SELECT count(*) AS {total}, count(d) AS {valid}, count(*) - count(d) AS {invalid},
  CAST(min(d) AS VARCHAR) AS {earliest}, CAST(max(d) AS VARCHAR) AS {latest}, count(DISTINCT d) AS {distinct}
FROM (SELECT {expr} AS d FROM {rows})"""


DATE_NAMES = ("total", "valid", "invalid", "earliest", "latest", "distinct_dates")
REPEAT_NAMES = ("total", "combinations", "repeated", "rows_repeated", "excess", "percentage_repeated")


def skill_top(rows: str) -> str:
    return f"""SELECT job_skills_normalized, count(DISTINCT job_link) AS job_count,
  {pct_even('count(DISTINCT job_link)', 'SELECT count(*) FROM combined', 2)} AS percentage
FROM {rows} WHERE job_skills_normalized NOT IN ({ANCHORS}) GROUP BY 1
ORDER BY job_count DESC, job_skills_normalized LIMIT 20"""


SHARES = f"""{CLEANED},
chosen AS (SELECT c.job_link, role_category, job_skills_normalized FROM cleaned c LEFT JOIN mart m USING (job_link)
  WHERE job_skills_normalized IN ({quoted(L.SHARE_SKILLS)})),
share_table AS (SELECT job_skills_normalized,
  count(DISTINCT job_link) / CAST((SELECT count(*) FROM cleaned) AS DOUBLE) AS all_share,
  count(DISTINCT CASE WHEN role_category = 'Business Analysis' THEN job_link END)
    / CAST((SELECT count(*) FROM cleaned WHERE role_category = 'Business Analysis') AS DOUBLE) AS core_share,
  count(DISTINCT CASE WHEN role_category <> 'Business Analysis' THEN job_link END)
    / CAST((SELECT count(*) FROM cleaned WHERE role_category <> 'Business Analysis') AS DOUBLE) AS other_share
  FROM chosen GROUP BY 1)
"""


def resolution(case: str) -> str:
    return f"""WITH {CLEAN_COHORT}, located AS (SELECT {case} AS state FROM us)
SELECT {n_if("state IS NOT NULL AND state <> 'NON_US'")} AS resolved_us, {n_if("state = 'NON_US'")} AS non_us,
  {n_if('state IS NULL')} AS unresolved, count(*) AS total FROM located"""


def doc_pieces(table: str, key: str) -> str:
    return f"""SELECT {key}, lower(trim(piece, ' ')) AS skill_term
  FROM (SELECT {key}, unnest(string_split(text, ',')) AS piece FROM {table})"""


def completeness_row(variable: str, test: str) -> str:
    filled = n_if(test)
    text = f"printf('%.2f%%', {pct_even(filled, 'count(*)', 2)})"
    return (
        f"SELECT '{variable}' AS variable, {filled} AS populated, count(*) - {filled} AS missing, "
        f"{text} AS complete_pct FROM cleaned"
    )


US_NAMES = (
    "total_us_ba_jobs", "distinct_job_titles", "titles_occurring_once", "titles_occurring_more_than_once",
    "jobs_with_one_off_titles", "percentage_of_titles_occurring_once",
)

ORACLES: dict[str, str] = {
    # --- size and coverage
    "table_profile": f"""WITH {ADVERTS_SQL}
SELECT 'job_postings' AS table_name, count(*) AS total_rows, count(DISTINCT job_link) AS distinct_job_links FROM postings
UNION ALL SELECT 'job_skills', count(*), count(DISTINCT job_link) FROM job_skills
UNION ALL SELECT 'job_summary', count(*), count(DISTINCT job_link) FROM job_summary""",
    "coverage_matrix": f"""WITH {ADVERTS_SQL}
SELECT count(*) AS total_postings, count(s.job_link) AS postings_with_skills,
  count(*) - count(s.job_link) AS postings_without_skills, count(j.job_link) AS postings_with_summary,
  count(*) - count(j.job_link) AS postings_without_summary,
  {n_if('s.job_link IS NOT NULL AND j.job_link IS NOT NULL')} AS postings_with_both
FROM postings p LEFT JOIN (SELECT DISTINCT job_link FROM job_skills) s ON p.job_link = s.job_link
LEFT JOIN (SELECT DISTINCT job_link FROM job_summary) j ON p.job_link = j.job_link""",
    "load_count": f"WITH {ADVERTS_SQL} SELECT count(*) AS loaded_rows FROM postings",
    "summary_preview": f"""WITH {ADVERTS_SQL}
SELECT job_link, left(job_summary, 500) AS job_summary_preview FROM job_summary ORDER BY job_link LIMIT 10""",
    # --- rule discovery
    "term_preview": f"""WITH {ADVERTS_SQL}
SELECT job_link, job_skills FROM job_skills WHERE lower(job_skills) LIKE '%business analy%'
ORDER BY job_link LIMIT 100""",
    "term_counts": f"""WITH {ADVERTS_SQL}, {TOKENS}
SELECT skill_term, count(DISTINCT job_link) AS job_count FROM tokens
WHERE skill_term LIKE '%business analy%' GROUP BY 1""",
    "compare_definitions": f"WITH {ADVERTS_SQL}, {TOKENS} " + " UNION ALL ".join(
        f"SELECT {sql_text(label)} AS definition, count(DISTINCT job_link) AS job_count FROM tokens WHERE {test}"
        for label, test in (
            ("Exact Business Analysis only", "skill_term = 'business analysis'"),
            ("Business Analysis or Business Analyst exact", f"skill_term IN ({ANCHORS})"),
            ("Broad BA-related terms excluding Business Analytics", BROAD_TERM),
        )
    ),
    "broad_only_terms": f"""WITH {ADVERTS_SQL}, {TOKENS}
SELECT job_link, skill_term FROM tokens b
WHERE {BROAD_TERM}
  AND (job_link IS NULL OR job_link NOT IN (SELECT job_link FROM tokens WHERE skill_term IN ({ANCHORS})))
ORDER BY skill_term, job_link LIMIT 100""",
    "overlap_audit": f"""WITH {COHORT}
SELECT count(*) AS total_business_analyst_titled_jobs, count(s.job_link) AS already_skill_confirmed,
  count(*) - count(s.job_link) AS missed_by_skill_rule
FROM titled p LEFT JOIN skill_keys s ON p.job_link = s.job_link""",
    "missed_titles": f"WITH {COHORT} {title_counts(missed('SELECT * FROM titled'))}",
    "wide_pattern_titles": f"""WITH {COHORT} {title_counts(missed(f'''SELECT * FROM postings
  WHERE regexp_matches(lower(job_title), 'business.*analyst', 's') AND NOT {TITLED_TEST} AND NOT {EXCLUDED_TEST}'''))}""",
    "family_counts": f"""WITH {COHORT}
SELECT candidate_title_family, count(*) AS job_count FROM {FAMILY_ROWS} GROUP BY 1""",
    "family_sample": f"""WITH {COHORT}, drawn AS (SELECT *, row_number() OVER (PARTITION BY candidate_title_family
    ORDER BY md5(job_link || ':42'), job_link) AS sample_number FROM {FAMILY_ROWS})
SELECT candidate_title_family, sample_number, job_title, job_skills, left(job_summary, 700) AS job_summary_preview
FROM drawn c LEFT JOIN job_skills USING (job_link) LEFT JOIN job_summary USING (job_link)
WHERE sample_number <= 15""",
    "evidence_by_family": f"""WITH {COHORT}
SELECT candidate_title_family, count(*) AS total_candidate_jobs, {EVIDENCE_COLUMNS}
FROM {evidence(FAMILY_ROWS)} GROUP BY 1""",
    "acronym_count": f"WITH {COHORT} SELECT count(*) AS ba_acronym_candidate_jobs FROM {ACRONYM_ROWS}",
    "acronym_titles": f"WITH {COHORT} {title_counts(ACRONYM_ROWS)}",
    "acronym_evidence": f"""WITH {COHORT}
SELECT count(*) AS total_ba_acronym_candidates, {EVIDENCE_COLUMNS} FROM {evidence(ACRONYM_ROWS)}""",
    # --- population
    "cohort_size": f"WITH {COHORT} SELECT count(*) AS refined_ba_population FROM cohort",
    "cohort_keys": f"WITH {COHORT} SELECT job_link FROM cohort",
    "country_distribution": f"""WITH {COHORT}, everywhere AS (SELECT p.* FROM cohort JOIN postings p USING (job_link))
{shares('everywhere', 'search_country', 'search_country', 'percentage_of_refined_ba_jobs')}""",
    "us_cohort": f"WITH {COHORT} SELECT job_link FROM us",
    "us_cohort_size": f"WITH {COHORT} SELECT count(*) AS refined_us_ba_population FROM us",
    "cleaning_cohort_overlap": f"""WITH {CLEAN_COHORT}
SELECT 'skill rule' AS key_set, count(*) AS n FROM skill_keys
UNION ALL SELECT 'title rule', count(*) FROM titled
UNION ALL SELECT 'already captured', count(*) FROM titled WHERE job_link IN (SELECT job_link FROM skill_keys)
UNION ALL SELECT 'missed by skill rule', count(*) FROM titled WHERE job_link NOT IN (SELECT job_link FROM skill_keys)
UNION ALL SELECT 'family, new', count(*) FROM families WHERE job_link NOT IN (SELECT job_link FROM skill_keys)
  AND job_link NOT IN (SELECT job_link FROM titled)
UNION ALL SELECT 'refined population', count(*) FROM members""",
    # --- quality
    "location_missing": f"""WITH {COHORT}
SELECT count(*) AS total_us_ba_jobs, {n_if("job_location IS NULL OR trim(job_location, ' ') = ''")} AS missing_job_location,
  {pct(n_if("job_location IS NULL OR trim(job_location, ' ') = ''"), 'count(*)')} AS percentage_missing,
  count(DISTINCT job_location) AS distinct_job_locations FROM us""",
    "temporal_coverage": f"WITH {ADVERTS_SQL} " + dates(
        "postings",
        "TRY_CAST(first_seen AS DATE)",
        (
            "total_job_postings", "postings_with_valid_first_seen_date", "postings_without_valid_first_seen_date",
            "earliest_first_seen_date", "latest_first_seen_date", "distinct_collection_dates",
        ),
    ),
    "type_distribution": f"WITH {COHORT} {shares('us', 'job_type', 'job_type', 'percentage_of_us_ba_jobs')}",
    "level_distribution": f"WITH {COHORT} {shares('us', 'job_level', 'job_level', 'percentage_of_us_ba_jobs')}",
    "employer_top": f"""WITH {COHORT}, company_counts AS (SELECT company, count(*) AS job_count FROM us GROUP BY 1)
SELECT company, job_count, {pct('job_count', n('sum(job_count) OVER ()'))} AS percentage_of_us_ba_jobs,
  count(*) OVER () AS distinct_companies
FROM company_counts ORDER BY job_count DESC, company NULLS FIRST LIMIT 30""",
    "skill_top_raw": f"WITH {COHORT} {raw_skills('us', 'percentage_of_us_ba_jobs', 30)}",
    "title_fragmentation": f"WITH {COHORT} {fragmentation('us', TRIM.format('job_title'), US_NAMES)}",
    "title_top": f"""WITH {COHORT} {shares('us', TRIM.format('us.job_title'), 'job_title', 'percentage_of_us_ba_jobs',
        top_tail('job_title', 30))}""",
    "repeat_audit": f"WITH {ADVERTS_SQL} " + repeats(
        "postings",
        KEY3,
        (
            "total_job_postings", "distinct_title_company_location_combinations", "repeated_combinations",
            "jobs_in_repeated_combinations", "potential_excess_records",
            "percentage_jobs_in_repeated_combinations",
        ),
    ),
    "city_agreement": f"""WITH {ADVERTS_SQL},
compared AS (SELECT trim(search_city, ' ') AS sc, trim(job_location, ' ') AS jl,
  lower(trim(regexp_extract(job_location, '^[^,]*'), ' ')) AS advertised, lower(trim(search_city, ' ')) AS searched FROM postings)
SELECT count(*) AS total_job_postings, {n_if("sc IS NULL OR sc = ''")} AS missing_search_city,
  {n_if("jl IS NULL OR jl = ''")} AS missing_job_location, {n_if('searched = advertised')} AS matching_city,
  {n_if('searched <> advertised')} AS nonmatching_city,
  {pct(n_if('searched <> advertised'), 'count(*)')} AS percentage_nonmatching FROM compared""",
    "checkpoint_duplicates": f"""WITH {CLEAN_COHORT}
SELECT {n_if('rn > 1')} AS duplicate_keys
FROM (SELECT row_number() OVER (PARTITION BY job_link) AS rn FROM combined)""",
    "encoding_audit": f"""WITH {CLEAN_COHORT}
SELECT {n_if('contains(job_title, chr(160))')} AS nbsp_count, {n_if("contains(job_title, 'â€')")} AS bad_dash_count
FROM combined""",
    "encoding_after_fix": f"WITH {TITLED} SELECT {n_if('contains(job_title, chr(160))')} AS nbsp_count FROM titles",
    "repost_count": f"""WITH {CLEANED} SELECT {n_if('is_likely_repost')} AS likely_reposts FROM flagged""",
    "level_values": f"WITH {CLEAN_COHORT} SELECT job_level, count(*) AS job_count FROM combined GROUP BY 1",
    "completeness": f"WITH {CLEANED} " + " UNION ALL ".join(
        [
            completeness_row(v, f"{v} IS NOT NULL" + (" AND state <> 'NON_US'" if v == "state" else ""))
            for v in ("job_link", "job_title", "role_category", "job_skills", "job_location", "state", "job_level")
        ]
    ),
    # --- repeats and sensitivity
    "repost_flags": f"""WITH {COHORT}
SELECT job_link, count(*) OVER (PARTITION BY job_title, company, job_location) > 1 AS is_likely_repost FROM us""",
    "sensitivity_keys": f"WITH {REDUCED} SELECT job_link FROM reduced",
    "sensitivity_counts": f"""WITH {REDUCED}, c AS (SELECT (SELECT count(*) FROM us) AS a, (SELECT count(*) FROM reduced) AS b)
SELECT a AS original_population, b AS sensitivity_population, a - b AS potential_repeated_records_removed,
  {pct('a - b', 'a')} AS percentage_removed FROM c""",
    "sensitivity_as_written": f"""WITH {TITLED},
c AS (SELECT (SELECT count(*) FROM mended) AS a,
  (SELECT count(*) FROM (SELECT DISTINCT job_title, company, job_location FROM mended)) AS b)
SELECT a AS before, b AS after, a - b AS removed, {pct_even('a - b', 'a', 2)} AS excluded_pct FROM c""",
    "sensitivity_top_titles": f"WITH {REDUCED} {top_values(TRIM.format('job_title'))}",
    "sensitivity_top_skills": f"WITH {REDUCED} {both(lambda rows: raw_skills(rows, 'percentage', 10, 'value'))}",
    "sensitivity_top_locations": f"WITH {REDUCED} {top_values('job_location')}",
    # --- cleaning and classification
    "handoff": f"""WITH {COHORT}
SELECT us.job_link, job_title, company, job_location, search_country, first_seen, job_skills, job_summary
FROM us LEFT JOIN job_skills USING (job_link) LEFT JOIN job_summary USING (job_link)""",
    "title_normalized": f"WITH {TITLED} SELECT job_link, job_title, job_title_normalized FROM titles",
    "normalized_title_variety": f"""WITH {TITLED}
SELECT count(DISTINCT job_title) AS distinct_titles, count(DISTINCT job_title_normalized) AS distinct_normalized
FROM titles""",
    "role_v1": role_shares("v1"),
    "role_v2": role_shares("v2"),
    "role_final": role_shares("final"),
    "role_all_postings": f"""WITH {ADVERTS_SQL},
t AS (SELECT {normalized("replace(job_title, chr(160), ' ')")} AS job_title_normalized FROM postings)
SELECT {role_case('final')} AS role_category, count(*) AS job_count FROM t GROUP BY 1""",
    "uncategorized_sample": f"""WITH {uncategorized('v1')}
SELECT job_link, job_title FROM leftovers ORDER BY md5(job_link || ':42'), job_link LIMIT 20""",
    "uncategorized_top": f"""WITH {uncategorized('v2')}
SELECT job_title_normalized, count(*) AS job_count FROM leftovers WHERE job_title_normalized IS NOT NULL
GROUP BY 1 {top_tail('job_title_normalized', 40)}""",
    "pattern_counts": f"WITH {uncategorized('v2')} " + " UNION ALL ".join(
        f"SELECT {sql_text(label)} AS pattern, {n_if(f'regexp_matches(job_title_normalized, {sql_text(p)})')} AS n FROM leftovers"
        for label, p in L.LEFTOVER_PATTERNS.items()
    ),
    "manager_abbreviation": rf"""WITH {TITLED}
SELECT 'mgr' AS pattern, count(*) FILTER (WHERE regexp_matches(job_title_normalized, '\bmgr\b')) AS n FROM titles""",
    "postings_export": f"""WITH {CLEANED}
SELECT job_link, job_title, job_title_normalized, role_category, company, job_location, state,
  CAST(TRY_CAST(first_seen AS DATE) AS VARCHAR) AS first_seen, job_level, job_type, is_likely_repost FROM cleaned""",
    # --- skills
    "skills_exploded": rf"""WITH {CLEAN_COHORT},
r AS (SELECT {STRIP.format("unnest(string_split(coalesce(job_skills, ''), ','))")} AS s FROM combined)
SELECT count(*) AS rows_exploded, {n_if("s <> ''")} AS rows_kept, {n_if("s = ''")} AS empty_removed,
  count(DISTINCT s) FILTER (WHERE s <> '') AS distinct_before,
  count(DISTINCT lower(s)) FILTER (WHERE s <> '') AS distinct_after,
  (SELECT count(*) FROM combined) AS postings FROM r""",
    "skills_folded_top": f"""WITH {CLEANED},
folded AS (SELECT job_link, lower(job_skills) AS job_skills_normalized FROM skill_rows WHERE job_skills <> '')
{skill_top('folded')}""",
    "skills_canonical_top": f"WITH {CLEANED} {skill_top('mart')}",
    "skills_export": f"WITH {CLEANED} SELECT job_link, job_skills, job_skills_normalized FROM mart",
    "skill_share": f"""WITH {SHARES}
SELECT *, CASE WHEN job_skills_normalized IN ('communication', 'problem solving', 'leadership')
    THEN 'A  Overall-frequency skills'
  WHEN job_skills_normalized IN ('requirements gathering', 'documentation', 'jira') THEN 'B  Core-BA practice skills'
  END AS skill_group FROM share_table""",
    "skill_share_unpivot": f"""WITH {SHARES}
SELECT job_skills_normalized, 'All BA-related' AS measure, all_share AS share FROM share_table
UNION ALL SELECT job_skills_normalized, 'Core Business Analysis', core_share FROM share_table""",
    "role_groups": f"""WITH {CLEANED}
SELECT CASE WHEN role_category = 'Business Analysis' THEN 'Core Business Analysis' ELSE 'Other BA-related roles' END
  AS role_group, count(*) AS job_count FROM cleaned GROUP BY 1""",
    # --- geography
    "location_last_part": f"""WITH {CLEAN_COHORT}
SELECT {LAST_PART} AS location_last_part, count(*) AS job_count FROM combined WHERE job_location IS NOT NULL
GROUP BY 1 {top_tail('location_last_part', 20)}""",
    "location_variety": f"""WITH {CLEAN_COHORT}
SELECT count(DISTINCT job_location) AS distinct_locations, count(DISTINCT {LAST_PART}) AS distinct_last_parts
FROM combined""",
    "state_extract": f"""WITH {LOCATED}
SELECT job_link, job_location, {LAST_PART} AS location_last_part, state FROM located""",
    "state_extract_strict": f"""WITH {CLEAN_COHORT}
SELECT job_link, {state_case(longest_first=True)} AS state FROM us""",
    "state_resolution_draft": resolution(state_case(metros=L.METRO_AREAS)),
    "state_resolution": resolution(state_case()),
    "unresolved_locations": f"""WITH {LOCATED}
SELECT job_location, count(*) AS job_count FROM located WHERE state IS NULL AND job_location IS NOT NULL
GROUP BY 1""",
    "state_top": f"""WITH {LOCATED}
SELECT state, count(*) AS job_count, {pct_even('count(*)', 'SELECT count(*) FROM located', 1)} AS percentage
FROM located WHERE state <> 'NON_US' GROUP BY 1 {top_tail('state', 15)}""",
    "state_totals": f"""WITH {LOCATED}
SELECT count(*) AS resolved_postings, count(DISTINCT state) AS distinct_states FROM located WHERE state <> 'NON_US'""",
    # --- the test tables themselves
    "document_profile": """SELECT 'documents' AS table_name, count(*) AS total_rows, count(DISTINCT doc_id) AS distinct_doc_ids
FROM documents UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id) FROM labels""",
    "document_coverage": f"""SELECT count(*) AS total_documents, count(a.doc_id) AS documents_with_label,
  count(*) - count(a.doc_id) AS documents_without_label, count(g.doc_id) AS documents_with_good_label,
  count(*) - count(g.doc_id) AS documents_without_good_label,
  {n_if('a.doc_id IS NOT NULL AND g.doc_id IS NOT NULL')} AS documents_with_both
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) a ON d.doc_id = a.doc_id
LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON d.doc_id = g.doc_id""",
    "document_terms": f"""WITH t AS ({doc_pieces('documents', 'doc_id')})
SELECT skill_term, count(DISTINCT doc_id) AS doc_count FROM t WHERE skill_term <> ''
GROUP BY 1 ORDER BY doc_count DESC, skill_term LIMIT 50""",
    "document_definitions": f"""WITH t AS ({doc_pieces('documents', 'doc_id')})
SELECT 'the' AS definition, count(DISTINCT doc_id) AS doc_count FROM t WHERE skill_term LIKE '%the%'
UNION ALL SELECT 'la', count(DISTINCT doc_id) FROM t WHERE skill_term = 'la'
UNION ALL SELECT 'data', count(DISTINCT doc_id) FROM t WHERE skill_term LIKE '%data%'""",
    "document_repeats": repeats("documents", "text", REPEAT_NAMES),
    "document_repeat_flags": "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_copy FROM documents",
    "document_first_copies": """SELECT doc_id, lang FROM
(SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "document_phrase_rate": f"""WITH f AS (SELECT lang, CAST(lower(text) LIKE '%version%' OR lower(text) LIKE '%license%'
  OR lower(text) LIKE '%data%' AS INTEGER) AS hit FROM documents)
SELECT lang, count(*) AS total, {n('sum(hit)')} AS with_flag, {n('count(*) - sum(hit)')} AS without_flag,
  {pct('sum(hit)', 'count(*)')} AS percentage FROM f GROUP BY 1""",
    "document_sample": """SELECT lang, sample_number, doc_id, left(text, 700) AS text_preview FROM
(SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) AS sample_number FROM documents)
WHERE sample_number <= 15""",
    "document_sources": f"""SELECT source, count(*) AS doc_count,
  {pct('count(*)', n('sum(count(*)) OVER ()'))} AS percentage FROM documents GROUP BY 1""",
    "label_overlap": """SELECT count(*) AS total, count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS missed
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
    "page_patterns": r"""SELECT 'title' AS pattern, count(*) FILTER (WHERE regexp_matches(html, '<title>')) AS n FROM pages
UNION ALL SELECT 'script', count(*) FILTER (WHERE regexp_matches(html, '<script\b')) FROM pages
UNION ALL SELECT 'french', count(*) FILTER (WHERE regexp_matches(html, 'lang="fr"')) FROM pages
UNION ALL SELECT 'list', count(*) FILTER (WHERE regexp_matches(html, '<li>|<ul>')) FROM pages""",
    "conversation_roles": f"""SELECT role, count(*) AS turns, {pct('count(*)', n('sum(count(*)) OVER ()'))} AS percentage
FROM conversations GROUP BY 1""",
    "conversation_tokens": f"""WITH t AS ({doc_pieces('conversations', 'conv_id')})
SELECT skill_term, count(DISTINCT conv_id) AS conv_count FROM t WHERE skill_term <> ''
GROUP BY 1 ORDER BY conv_count DESC, skill_term LIMIT 30""",
    "order_priorities": f"""SELECT o_orderpriority, count(*) AS orders,
  {pct_even('count(*)', 'SELECT count(*) FROM orders', 2)} AS percentage FROM orders o GROUP BY 1""",
    "order_dates": dates("orders", "CAST(o_orderdate AS DATE)", DATE_NAMES),
    "shipping_dates": dates("lineitem", "CAST(l_shipdate AS DATE)", DATE_NAMES),
    "event_days": dates("events", "CAST(ts AS DATE)", DATE_NAMES),
    "event_type_rate": f"""WITH f AS (SELECT event_type, CAST(value > 50 AS INTEGER) AS hit FROM events)
SELECT event_type, count(*) AS total, {n('coalesce(sum(hit), 0)')} AS with_flag,
  {n('count(*) - coalesce(sum(hit), 0)')} AS without_flag, {pct('coalesce(sum(hit), 0)', 'count(*)')} AS percentage
FROM f GROUP BY 1""",
    "customer_orders_top": f"""WITH c AS (SELECT c_name, count(*) AS job_count FROM orders
  JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_name, job_count, {pct('job_count', n('sum(job_count) OVER ()'))} AS percentage,
  count(*) OVER () AS distinct_customers FROM c ORDER BY job_count DESC, c_name LIMIT 30""",
    "part_name_fragmentation": fragmentation(
        "part", "p_name", ("total", "distinct_values", "once", "repeated", "rows_once", "percentage_once")
    ),
    "lineitem_repeats": repeats("lineitem", "l_partkey, l_suppkey", REPEAT_NAMES),
    "segment_share": " UNION ALL ".join(
        f"""SELECT c_mktsegment, '{label}' AS measure,
  count(DISTINCT CASE WHEN o_orderstatus = '{s}' THEN c_custkey END)
    / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS value
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1"""
        for s, label in (("F", "finished"), ("O", "open"), ("P", "partial"))
    ),
}
ORACLES["handoff_from_saved_keys"] = ORACLES["handoff"]
ORACLES["skills_csv_round_trip"] = ORACLES["skills_export"]
# an empty field is NULL when read
ORACLES["postings_csv_round_trip"] = f"""SELECT * REPLACE (nullif(job_location, '') AS job_location)
FROM ({ORACLES['postings_export']})"""
ORACLES["summaries_streamed"] = f"""WITH {ADVERTS_SQL}
SELECT job_link, md5(job_summary) AS summary_md5 FROM job_summary"""

from . import loading_sql, sketches_sql  # noqa: E402, F401  add the twins of further queries
