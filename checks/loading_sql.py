"""DuckDB twins of the queries in ``loading``."""

from __future__ import annotations

from rolescope import schemas
from rolescope.functions import lookups as L

from .adverts import ADVERTS_SQL
from .oracles import (
    ANCHORS, CLEAN_COHORT, COHORT, LAST_PART, LOCATED, ORACLES, fragmentation, n, n_if, pct, state_case, top_tail,
)

EXPORTED = "job_link, job_title, company, job_location, search_country"
DIGIT = "right(job_link, 1)"
LINE = """job_link || ',"' || coalesce(job_skills, '') || '"'"""


def nulls(names) -> str:
    """An empty CSV field is NULL."""
    return ", ".join(f"nullif({c}, '') AS {c}" for c in names)


def missing(rows: str, col: str, names=("total", "missing", "percentage_missing", "distinct_values")) -> str:
    total, gaps, share, distinct = names
    absent = n_if(f"{col} IS NULL")
    return f"""SELECT count(*) AS {total}, {absent} AS {gaps}, {pct(absent, 'count(*)')} AS {share},
  count(DISTINCT {col}) AS {distinct} FROM {rows}"""


FRAGMENTS = ("total", "distinct_values", "once", "repeated", "rows_once", "percentage_once")
OUTCOMES = {"loaded": f"{DIGIT} NOT IN ('3', '7')", "short": f"{DIGIT} = '3'", "long": f"{DIGIT} = '7'", "unclosed": "false"}

ORACLES |= {
    "postings_by_header": f"WITH {ADVERTS_SQL} SELECT {nulls(schemas.POSTINGS.names)} FROM postings",
    "cleaning_columns_by_header": f"WITH {ADVERTS_SQL} SELECT {nulls(schemas.CLEANING_COLUMNS)} FROM postings",
    "load_outcomes": f"WITH {ADVERTS_SQL} " + " UNION ALL ".join(
        f"SELECT '{name}' AS outcome, {n_if(test)} AS n_records FROM job_skills" for name, test in OUTCOMES.items()
    ),
    "rejected_records": f"""WITH {ADVERTS_SQL}
SELECT 'short' AS reason, job_link AS text FROM job_skills WHERE {DIGIT} = '3'
UNION ALL SELECT 'long', {LINE} || ',more' FROM job_skills WHERE {DIGIT} = '7'""",
    "accepted_records": f"""WITH {ADVERTS_SQL}
SELECT {nulls(schemas.SKILLS.names)} FROM job_skills WHERE {DIGIT} NOT IN ('3', '7')""",
    "summaries_split": f"WITH {ADVERTS_SQL} SELECT job_link, md5(job_summary) AS summary_md5 FROM job_summary",
    "arrivals_loaded": f"""WITH {ADVERTS_SQL}
SELECT {nulls(schemas.SKILLS.names)}, CAST(CASE WHEN {DIGIT} IN ('1', '4', '8') THEN 2 ELSE 1 END AS BIGINT) AS batch
FROM job_skills""",
    "reload_flow": f"WITH {COHORT} SELECT {EXPORTED}, CAST(0 AS BIGINT) AS rows_before FROM us",
    "permanent_table_export": f"WITH {COHORT} SELECT {EXPORTED} FROM us",
    "share_view_from_files": ORACLES["skill_share_unpivot"],
    "unresolved_locations_draft": f"""WITH {CLEAN_COHORT},
located AS (SELECT *, {state_case(metros=L.METRO_AREAS)} AS state FROM us)
SELECT job_location, count(*) AS job_count FROM located WHERE state IS NULL AND job_location IS NOT NULL
GROUP BY 1 {top_tail('job_location', 20)}""",
    "unresolved_companies": f"""WITH {ADVERTS_SQL}, places AS (SELECT trim(company, ' ') AS job_location FROM postings)
SELECT job_location, count(*) AS job_count FROM places WHERE ({state_case()}) IS NULL AND job_location IS NOT NULL
GROUP BY 1""",
    "null_locations": f"WITH {CLEAN_COHORT} {missing('combined', 'job_location')}",
    "population_dates": f"""WITH {CLEAN_COHORT}
SELECT CAST(min(TRY_CAST(first_seen AS DATE)) AS VARCHAR) AS earliest,
  CAST(max(TRY_CAST(first_seen AS DATE)) AS VARCHAR) AS latest FROM us""",
    "title_variety_known": f"""WITH {CLEAN_COHORT}, known AS (SELECT * FROM us WHERE job_title IS NOT NULL)
{fragmentation('known', 'job_title', FRAGMENTS)}""",
    "adverts_without_skills": f"WITH {CLEAN_COHORT} "
    + missing("combined", "job_skills", ("postings", "without_skills", "percentage", "lists")),
    "skill_top_folded": f"""WITH {COHORT}
SELECT skill_term AS skill, count(DISTINCT job_link) AS job_count,
  {pct('count(DISTINCT job_link)', 'SELECT count(*) FROM us')} AS percentage_of_us_ba_jobs
FROM us JOIN tokens USING (job_link) WHERE skill_term <> '' AND skill_term NOT IN ({ANCHORS})
GROUP BY 1 {top_tail('skill', 30)}""",
    "bounded_summaries": f"""WITH {ADVERTS_SQL}
SELECT count(DISTINCT job_summary) AS distinct_summaries, count(DISTINCT left(job_summary, 300)) AS distinct_bounded
FROM job_summary""",
    "repeated_order_keys": f"SELECT {n('count(*) - count(DISTINCT l_orderkey)')} AS duplicate_keys FROM lineitem",
    "heavy_sources": "SELECT source, count(*) AS docs FROM documents GROUP BY 1 HAVING count(*) > 100",
    "documents_with_source_size": "SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS docs FROM documents",
    "source_documents": """SELECT s.source, doc_id
FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT r_name FROM region) s LEFT JOIN documents USING (source)""",
}
