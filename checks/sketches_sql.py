"""DuckDB twins of the queries in ``sketches``."""

from __future__ import annotations

from .adverts import ADVERTS_SQL
from .oracles import DATE_NAMES, ORACLES, TOKENS, dates, n_if, pct, shares, top_tail

BLANK = "job_location IS NULL OR trim(job_location, ' ') = ''"

ORACLES |= {
    "distinct_parts_by_flag": """SELECT l_returnflag, count(DISTINCT l_partkey) AS distinct_parts, true AS within_bound
FROM lineitem GROUP BY 1""",
    "distinct_locations_sketched": f"""WITH {ADVERTS_SQL}
SELECT count(DISTINCT job_location) AS distinct_locations, true AS within_bound FROM postings""",
    "title_top_proved": f"""WITH {ADVERTS_SQL}
SELECT job_title, count(*) AS job_count, true AS proved FROM postings WHERE job_title IS NOT NULL
GROUP BY 1 {top_tail('job_title', 15)}""",
    "busy_orders": """SELECT l_orderkey, count(*) AS lines, false AS proved FROM lineitem
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "skill_terms_proved": f"""WITH {ADVERTS_SQL}, {TOKENS}
SELECT skill_term, count(DISTINCT job_link) AS job_count, true AS proved FROM tokens WHERE skill_term <> ''
GROUP BY 1 {top_tail('skill_term', 10)}""",
    "lines_of_urgent_orders": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "large_line_sample": """WITH lines AS (
  SELECT l_returnflag, l_orderkey || '-' || l_linenumber AS line FROM lineitem)
SELECT l_returnflag, line, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(line || ':42'), line) AS sample_number
FROM lines QUALIFY sample_number <= 5000""",
    "batch_profile": f"""WITH {ADVERTS_SQL}
SELECT 'job_postings' AS table_name, count(*) AS total_rows, count(DISTINCT job_link) AS distinct_job_links FROM postings""",
    "batch_types": f"WITH {ADVERTS_SQL} {shares('postings', 'job_type', 'job_type', 'percentage')}",
    "batch_locations": f"""WITH {ADVERTS_SQL}
SELECT count(*) AS total, {n_if(BLANK)} AS missing, {pct(n_if(BLANK), 'count(*)')} AS percentage_missing,
  count(DISTINCT job_location) AS distinct_values FROM postings""",
    "batch_dates": f"WITH {ADVERTS_SQL} " + dates("postings", "TRY_CAST(first_seen AS DATE)", DATE_NAMES),
}
