"""Registered queries over what is written and read back: CSV, arrivals, reloads, splits of hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope import schemas
from rolescope.functions.geo import DRAFT_LOOKUPS
from rolescope.functions.text import bounded_key
from rolescope.operators import profile as P
from rolescope.operators.dictionary import ROWS
from rolescope.operators.keys import enrich
from rolescope.operators.skew import heavy_counts, hot_keys
from rolescope.plans import cleaning, geography, quality, sharing, skills
from rolescope.sources import reload
from rolescope.sources.files import CSV_OPTIONS, read_clean_postings, read_clean_skills, write_csv
from rolescope.sources.headers import read_by_header
from rolescope.sources.tables import export_columns, shared_path
from rolescope.streaming.arrivals import load_arrivals, loaded

from .queries import clean_rows, combined, located, on_adverts, on_tables, roles, skill_lists, us

EXPORTED = ("job_link", "job_title", "company", "job_location", "search_country")


def _in_two_layouts(a) -> str:
    """The postings as CSV, one half with its columns the other way round and one more."""
    folder = shared_path(a.spark, "postings_layouts")
    half = F.pmod(F.xxhash64("job_link"), F.lit(2)) == 0
    write_csv(a.postings.where(half), f"{folder}/as_named")
    turned = a.postings.where(~half).select(F.lit("x, y").alias("note"), *reversed(schemas.POSTINGS.names))
    write_csv(turned, f"{folder}/turned")
    return folder


@on_adverts
def postings_by_header(a):
    """Files whose columns stand in different orders, bound by name."""
    folder = _in_two_layouts(a)
    return read_by_header(a.spark, [f"{folder}/as_named", f"{folder}/turned"], schemas.POSTINGS).rows


@on_adverts
def cleaning_columns_by_header(a):
    """The columns of the cleaning job only."""
    folder = _in_two_layouts(a)
    paths = [f"{folder}/as_named", f"{folder}/turned"]
    return read_by_header(a.spark, paths, schemas.POSTINGS, columns=schemas.CLEANING_COLUMNS).rows


def _with_bad_records(a):
    """Skill lists as raw lines: of every ten keys one has no list field and one a field too many."""
    digit = F.substring("job_link", -1, 1)
    line = F.concat("job_link", F.lit(',"'), F.coalesce("job_skills", F.lit("")), F.lit('"'))
    line = F.when(digit == "3", F.col("job_link")).when(digit == "7", F.concat(line, F.lit(",more"))).otherwise(line)
    path = shared_path(a.spark, "skills_raw")
    plain = {"header": "true", "sep": "\x01", "quote": "", "escape": ""}
    a.skills.select(line.alias("job_link,job_skills")).write.options(**plain).csv(path)
    return read_by_header(a.spark, path, schemas.SKILLS)


@on_adverts
def load_outcomes(a):
    return _with_bad_records(a).counts()


@on_adverts
def rejected_records(a):
    return _with_bad_records(a).rejects.select("reason", "text")


@on_adverts
def accepted_records(a):
    return _with_bad_records(a).rows


@on_adverts
def summaries_split(a):
    """Descriptions with line breaks, read by the splitting reader."""
    path = shared_path(a.spark, "summaries_split")
    write_csv(a.summaries, path)
    rows = read_by_header(a.spark, path, schemas.SUMMARIES).rows
    return rows.select("job_link", F.md5("job_summary").alias("summary_md5"))


@on_adverts
def arrivals_loaded(a):
    """Skill lists that arrive in two deliveries, each loaded once."""
    source, folder = shared_path(a.spark, "arrivals"), shared_path(a.spark, "arrivals_loaded")
    late = F.substring("job_link", -1, 1).isin("1", "4", "8")
    for part in (~late, late):
        a.skills.where(part).write.mode("append").options(**CSV_OPTIONS).csv(source)
        for _ in range(2):  # the second run finds nothing new
            load_arrivals(a.spark, source, folder, schemas.SKILLS, files_per_batch=1000)
    return loaded(a.spark, folder, schemas.SKILLS)


@on_adverts
def reload_flow(a):
    """A reload that fails midway and one with a wrong count change nothing; a good one does."""
    folder = shared_path(a.spark, "postings_reloaded")
    reload.reload(a.postings.limit(0), folder, expect=0)
    stop = F.when(F.col("job_link").endswith("0"), F.raise_error(F.lit("load cut short")).cast("string"))
    broken = a.postings.withColumn("job_title", F.coalesce(stop, F.col("job_title")))
    for rows, expect in ((broken, None), (a.postings, -1)):
        try:
            reload.reload(rows, folder, expect=expect)
        except Exception:
            continue
        raise AssertionError("a bad load went through")
    before = reload.current(a.spark, folder).count()
    population = us(a).select(*EXPORTED)
    reload.reload(population, folder, expect=population.count())
    rows = reload.current(a.spark, folder)
    return rows.withColumn("rows_before", F.lit(before).cast("long"))


@on_adverts
def permanent_table_export(a):
    """The population as a catalog table, replaced as a whole, and a column list of it."""
    name = shared_path(a.spark, "population").rpartition("/")[2].replace("-", "_")
    reload.reload_table(a.postings, name)
    reload.reload_table(us(a), name, test=lambda df: df.where("search_country <> 'United States'").isEmpty())
    return export_columns(a.spark, name, EXPORTED)


@on_adverts
def share_view_from_files(a):
    """The share view from the two exported files, as the dashboard reads them."""
    folder = shared_path(a.spark, "exports")
    write_csv(cleaning.postings_export(cleaning.clean_postings(clean_rows(a))), f"{folder}/postings")
    write_csv(skills.skill_mart(skill_lists(a)), f"{folder}/skills")
    return sharing.skill_share_view(
        read_clean_postings(a.spark, f"{folder}/postings"), read_clean_skills(a.spark, f"{folder}/skills")
    )


# --- forms that had no query ----------------------------------------------------------


@on_adverts
def unresolved_locations_draft(a):
    """The first pass's twenty most frequent."""
    return geography.unresolved_locations(located(a, lookups=DRAFT_LOOKUPS), k=20, weight=ROWS)


@on_adverts
def unresolved_companies(a):
    """Far more than twenty places without a state, none cut off."""
    places = a.postings.select(F.trim("company").alias("job_location"))
    return geography.unresolved_locations(cleaning.locations_by_value(places), weight=ROWS)


@on_adverts
def null_locations(a):
    return P.missing_audit(combined(a), "job_location", null_only=True)


@on_adverts
def population_dates(a):
    return P.temporal_coverage(clean_rows(a), "first_seen").select("earliest", "latest")


@on_adverts
def title_variety_known(a):
    known = clean_rows(a).where(F.col("job_title").isNotNull())
    return P.fragmentation(known, "job_title")


@on_adverts
def adverts_without_skills(a):
    return P.missing_audit(combined(a), "job_skills", ("postings", "without_skills", "percentage", "lists"), True)


@on_adverts
def skill_top_folded(a):
    """Skills as written but for their case."""
    return skills.top_raw_skills(us(a), a.skills, fold_case=True)


@on_adverts
def bounded_summaries(a):
    """Distinct descriptions, whole and by a key of bounded length."""
    keys = a.summaries.select("job_summary", bounded_key("job_summary", 300).alias("bounded"))
    return P.distinct_counts(keys, {"distinct_summaries": "job_summary", "distinct_bounded": "bounded"})


@on_tables
def repeated_order_keys(t):
    """Keys that do repeat: every line of an order after its first."""
    return P.duplicate_key_audit(t("lineitem"), "l_orderkey")


# --- hot keys -------------------------------------------------------------------------


@on_tables
def heavy_sources(t):
    """Document sources with more than a hundred documents, found by sketch and counted exactly."""
    docs = t("documents")
    counts = heavy_counts(docs, "source", rows=100)
    return docs.sparkSession.createDataFrame(list(counts.items()), "source string, docs long")


@on_tables
def documents_with_source_size(t):
    """Each document with the size of its source: the key is hot on the left."""
    docs = t("documents").select("doc_id", "source")
    sizes = docs.groupBy("source").agg(P.every().alias("docs"))
    return enrich(docs, sizes, "source", hot=hot_keys(docs, sizes, "source", rows=100))


@on_tables
def source_documents(t):
    """Each source, and ones that have no document, with its documents: the key is hot on the right."""
    docs = t("documents").select("doc_id", "source")
    names = docs.select("source").distinct().unionByName(t("region").select(F.col("r_name").alias("source")))
    return enrich(names, docs, "source", hot=hot_keys(names, docs, "source", rows=100))
