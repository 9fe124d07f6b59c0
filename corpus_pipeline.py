"""Cleans the document table in five stages; each works on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from rolescope.llm.columns import numbered
from rolescope.llm.package import ship
from rolescope.llm.queries import RANKS, fold, hold_batches
from rolescope.llm.store import stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def _ready(spark: SparkSession) -> None:
    hold_batches(ship(spark))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field trained on the labelled ones scores below 0.3; null doc_ids included."""
    _ready(spark)
    field = toxicity.train(docs, _table(spark, sf_dir, "labels"), fold(4) != 2)
    return toxicity.keep_clean(docs, field, 0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without recurring lines; n_chars follows the text."""
    counted = [c for c in ("n_chars",) if c in docs.columns]
    plain, names = numbered(docs, "doc_id", "text", *counted)
    out = line_dedup.drop_recurring(plain)
    for c in counted:
        out = out.withColumn(c, F.length("text").cast(plain.schema[c].dataType))
    return out.select(*plain.columns).toDF(*names)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of linked ones; null doc_ids stay.

    Linked are those whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    _ready(spark)
    groups = jaccard_join.link_groups(docs, percent=80, size=5)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _ready(spark)
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text back."""
    _ready(spark)
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", keep_one),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: No stage's model or hashing can be said in SQL. tests/llm/test_whole_jobs.py holds what run() makes of
#: the documents that the first stage, a trained model, has kept against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
