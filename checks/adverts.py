"""Advert tables derived from the test tables, once as DataFrames and once as SQL.

Every order is an advert of its customer, every document the description of one advert.
Titles, locations and skills come from the lists below, chosen by arithmetic on the keys,
so that each branch of the rules is met. Both forms read whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope import schemas

LINK = "https://jobs.example/view/"

TITLES = (
    "Business Analyst",
    "Senior Business Analyst",
    "Sr. Business Analyst",
    "  Business Analyst ",
    "Business\u00a0Analyst II",
    "BUSINESS ANALYST - Payments",
    "Business Analyst, Business Analytics",
    "Business\u00a0Analyst Lead",
    "Business Analytics Lead",
    "Business Systems Analyst",
    "Business System Analyst Jr",
    "Sr Business Systems Analyst",
    "Business Process Analyst",
    "Business Data Analyst",
    "Business Intelligence Analyst",
    "BA - Payments",
    "Sr. BA/PO",
    "Program Manager/BA (Remote)",
    "BAse Operator",
    "Data Analyst",
    "Director of Analytics",
    "Data Entry Clerk",
    "Project Manager",
    "IT Project Manager",
    "Systems Analyst",
    "Enterprise Architect",
    "Software Engineer",
    "Ecosystems Analyst",
    "Head of IT",
    "Cloud Architect",
    "Tax Associate",
    "Financial Analyst",
    "Sr. Accountant",
    "Salesforce Consultant",
    "Account Executive",
    "Store Mgr",
    "Implementation Consultant",
    "Operations Manager",
    "Office Mgr.",
    "Pricing Analyst",
    "HR Generalist",
    "Scrum Master â€“ Agile",
    "Human Resources Partner",
    None,
)

LOCATIONS = (
    "New York, NY",
    "New York, New York, United States",
    "Boston, MA",
    " Boston, MA ",
    "austin, tx",
    "Austin, Texas, United States",
    "Charleston, West Virginia, United States",
    "Charleston, WV",
    "Washington, DC",
    "Washington DC-Baltimore Area",
    "Washington, District of Columbia, United States",
    "Little Rock, Arkansas, United States",
    "Kansas City Metropolitan Area",
    "San Francisco Bay Area",
    "Greater Houston",
    "Greater Minneapolis-St. Paul Area",
    "Greater St. Louis",
    "Greater Jacksonville, NC Area",
    "Pueblo-Cañon City Area",
    "Greater Tampa Bay Area",
    "Salt Lake City Metropolitan Area",
    "Utica-Rome Area",
    "Toronto, Ontario, Canada",
    "Mexico City, Mexico",
    "New Mexico, United States",
    "Ankara, Turkey",
    "United States",
    "Remote",
    "Springfield, Unknown, United States",
    "",
    "   ",
    None,
    "Chicago, IL",
    "Chicago, Illinois, United States",
    "Atlanta Metropolitan Area",
    "Los Angeles, CA",
)

SKILLS = (
    "Business Analysis",
    "business analyst",
    "BUSINESS ANALYSIS ",
    "Senior Business Analyst skills",
    "Business Analytics",
    "problemsolving",
    "ProblemSolving Skills",
    "Problem Solving",
    "Communication Skills",
    "written communication",
    "Verbal Communication",
    "Communication",
    "communication",
    "Microsoft Office Suite",
    "Microsoft Office",
    "Agile Development",
    "Agile",
    "Analytical Thinking",
    "Analytical Skills",
    "Team Leadership",
    "Leadership",
    "Stakeholder Engagement",
    "Stakeholder Management",
    "Project Management",
    "Data Analysis",
    "SQL",
    "sql",
    "Teamwork",
    "Requirements Gathering",
    "Documentation",
    "Jira",
    "\u00a0JIRA",
    "Process Mapping",
    "User Stories",
    "Gap Analysis",
    "",
    "   ",
    "Python",
    "Excel",
    "Dashboards",
    "Accounting",
    "Negotiation",
    "Scheduling",
    "Forklift",
    "Nursing",
    "Welding",
    "Customer Service",
)

TAILS = (
    "",
    " Gathers REQUIREMENTS.",
    "",
    " Reports to every stakeholder.",
    "",
    " Process Analysis and process improvement.",
    "",
    " Owns process mapping.",
    " Writes user stories.",
    "",
    " Leads gap analysis.",
    " Knows functional requirements.",
    "",
)

COUNTRIES = ("United States", "United States", "Canada", "United States", "United Kingdom", "United States", "Australia")

_K, _CU = "o_orderkey", "o_custkey"
SKILL_PICKS = (_K, f"{_K} * 5 + {_CU}", _CU, f"{_K} * 11 + {_CU} * 3", f"{_K} * 13", f"{_K} * 17 + {_CU} * 7")


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _pick(values: tuple, index: str) -> Column:
    # one expression text instead of a call to the JVM per list entry
    return F.expr(f"get(array({', '.join(map(sql_text, values))}), CAST(({index}) % {len(values)} AS INT))")


def _link(key: str) -> Column:
    return F.concat(F.lit(LINK), F.col(key).cast("string")).alias("job_link")


class Adverts:
    """The three tables as DataFrames, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")

    @cached_property
    def _orders(self) -> DataFrame:
        return self._read("orders")

    @cached_property
    def postings(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        price = F.col("o_totalprice")
        day = F.col("o_orderdate").cast("date").cast("string")
        columns = {
            "job_link": _link("o_orderkey"),
            "last_processed_time": day,
            "got_summary": F.lit("t"),
            "got_ner": F.lit("t"),
            "is_being_worked": F.lit("f"),
            "job_title": _pick(TITLES, f"{_K} * 7 + {_CU}"),
            "company": F.when(priority == "1-URGENT", F.upper("c_name"))
            .when(priority == "5-LOW", F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
            .otherwise(F.col("c_name")),
            "job_location": _pick(LOCATIONS, f"{_K} * 3 + {_CU} * 5"),
            "first_seen": F.when(price < 8000, F.lit("2024-13-45"))
            .when(price > 495000, F.lit(None).cast("string"))
            .otherwise(day),
            "search_city": F.substring_index(_pick(LOCATIONS, f"{_K} * 3 + {_CU} * 5 + {_CU} % 3"), ",", 1),
            "search_country": _pick(COUNTRIES, "c_nationkey"),
            "search_position": _pick(TITLES, _K),
            "job_level": F.col("o_orderstatus"),
            "job_type": priority,
        }
        joined = self._orders.join(self._read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(*[columns[n].alias(n) for n in schemas.POSTINGS.names])

    @cached_property
    def skills(self) -> DataFrame:
        picks = [_pick(SKILLS, index) for index in SKILL_PICKS]
        text = F.concat(
            picks[0], F.lit(", "), picks[1], F.lit(","), picks[2], F.lit(", "), picks[3], F.lit(" , "), picks[4],
            F.lit(","), picks[5],
        )
        # adverts of the cheapest orders list no skills, those of the dearest an unknown list
        return self._orders.filter(F.col("o_totalprice") >= 25000).select(
            _link("o_orderkey"), F.when(F.col("o_totalprice") <= 490000, text).alias("job_skills")
        )

    @cached_property
    def summaries(self) -> DataFrame:
        text = F.concat(F.col("text"), _pick(TAILS, "doc_id"))
        return self._read("documents").select(_link("doc_id"), text.alias("job_summary"))


def _sql_pick(values: tuple, index: str) -> str:
    return f"([{', '.join(map(sql_text, values))}])[CAST(({index}) % {len(values)} AS BIGINT) + 1]"


ADVERTS_SQL = f"""
postings AS (
  SELECT '{LINK}' || o_orderkey AS job_link,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS last_processed_time,
         't' AS got_summary, 't' AS got_ner, 'f' AS is_being_worked,
         {_sql_pick(TITLES, f'{_K} * 7 + {_CU}')} AS job_title,
         CASE o_orderpriority WHEN '1-URGENT' THEN upper(c_name) WHEN '5-LOW' THEN ' ' || c_name || ' '
              ELSE c_name END AS company,
         {_sql_pick(LOCATIONS, f'{_K} * 3 + {_CU} * 5')} AS job_location,
         CASE WHEN o_totalprice < 8000 THEN '2024-13-45' WHEN o_totalprice > 495000 THEN NULL
              ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS first_seen,
         split_part({_sql_pick(LOCATIONS, f'{_K} * 3 + {_CU} * 5 + {_CU} % 3')}, ',', 1) AS search_city,
         {_sql_pick(COUNTRIES, 'c_nationkey')} AS search_country,
         {_sql_pick(TITLES, _K)} AS search_position,
         o_orderstatus AS job_level, o_orderpriority AS job_type
  FROM orders JOIN customer ON o_custkey = c_custkey),
job_skills AS (
  SELECT '{LINK}' || o_orderkey AS job_link,
         CASE WHEN o_totalprice <= 490000 THEN
           {_sql_pick(SKILLS, SKILL_PICKS[0])} || ', ' || {_sql_pick(SKILLS, SKILL_PICKS[1])} || ',' ||
           {_sql_pick(SKILLS, SKILL_PICKS[2])} || ', ' || {_sql_pick(SKILLS, SKILL_PICKS[3])} || ' , ' ||
           {_sql_pick(SKILLS, SKILL_PICKS[4])} || ',' || {_sql_pick(SKILLS, SKILL_PICKS[5])}
         END AS job_skills
  FROM orders WHERE o_totalprice >= 25000),
job_summary AS (
  SELECT '{LINK}' || doc_id AS job_link, text || {_sql_pick(TAILS, 'doc_id')} AS job_summary FROM documents)
"""
