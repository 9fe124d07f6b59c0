"""Registered queries of sketches, bitmaps, large samples and audits by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescope.operators import increments
from rolescope.operators.bitmaps import restrict_large
from rolescope.operators.distinct_sketches import distinct_sketches, error_bound, merged_counts
from rolescope.operators.heavy_top import top_terms, top_values
from rolescope.operators.profile import distinct_counts
from rolescope.operators.sample import large_sample_per_group
from rolescope.operators.tokens import explode_list
from rolescope.sources.tables import shared_path, stored

from .queries import on_adverts, on_tables


@on_tables
def distinct_parts_by_flag(t):
    """Distinct parts per return flag, exact, and whether stored sketches by ship date agree within their bound."""
    lines = t("lineitem")
    sketches = stored(distinct_sketches(lines, ["l_returnflag", "l_shipdate"], "l_partkey"), "part_sketches")
    estimates = merged_counts(sketches, ["l_returnflag"], "estimate")
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("distinct_parts"))
    off = F.abs(F.col("estimate") - F.col("distinct_parts")) / F.col("distinct_parts")
    both = exact.join(estimates, "l_returnflag")
    return both.select("l_returnflag", "distinct_parts", (off <= error_bound()).alias("within_bound"))


@on_adverts
def distinct_locations_sketched(a):
    """The same over all, from sketches per country."""
    sketches = stored(distinct_sketches(a.postings, ["search_country"], "job_location"), "location_sketches")
    exact = distinct_counts(a.postings, {"distinct_locations": "job_location"})
    estimate = merged_counts(sketches, n="estimate").scalar()
    off = F.abs(estimate - F.col("distinct_locations")) / F.col("distinct_locations")
    return exact.withColumn("within_bound", off <= error_bound())


@on_adverts
def title_top_proved(a):
    """Titles repeat: the sketch is enough."""
    best, proved = top_values(a.postings, "job_title", 15)
    return best.withColumn("proved", F.lit(proved))


@on_tables
def busy_orders(t):
    """No order stands out: all are counted."""
    best, proved = top_values(t("lineitem"), "l_orderkey", 20, "lines", tracked=1000)
    return best.withColumn("proved", F.lit(proved))


@on_adverts
def skill_terms_proved(a):
    tokens = explode_list(a.skills, "job_skills", ["job_link"])
    best, proved = top_terms(tokens, 10)
    return best.withColumn("proved", F.lit(proved))


@on_tables
def lines_of_urgent_orders(t):
    """A key set of the size of the table: a bitmap at the scan, then the exact join."""
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return restrict_large(lines, urgent, "l_orderkey")


@on_tables
def large_line_sample(t):
    """Five thousand lines of each return flag."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    lines = t("lineitem").select("l_returnflag", key.alias("line"))
    return large_sample_per_group(lines, "l_returnflag", 5000, "line")


AUDITED = ("job_link", "job_type", "job_location", "first_seen")


def _audited(a) -> str:
    """The state of the postings in three batches, one of them entered twice."""
    folder = shared_path(a.spark, "audit_state")
    for batch in (0, 1, 2, 1):
        own = F.pmod(F.length("company") + F.length("job_type"), F.lit(3)) == batch
        increments.add_batch(a.postings.where(own), AUDITED, folder, batch)
    return folder


@on_adverts
def batch_profile(a):
    return increments.table_profile(a.spark, _audited(a), "job_postings", "job_link")


@on_adverts
def batch_types(a):
    return increments.distribution(a.spark, _audited(a), "job_type")


@on_adverts
def batch_locations(a):
    return increments.missing_audit(a.spark, _audited(a), "job_location")


@on_adverts
def batch_dates(a):
    return increments.temporal_coverage(a.spark, _audited(a), "first_seen")
