"""The operators over their whole tables, with production parameters, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    decontaminate,
    hard_negatives,
    importance,
    jaccard_join,
    line_dedup,
    ngram_lm,
    quality,
    secrets,
    simhash,
    substring,
    toxicity,
    url_filter,
)
from .package import ship
from .store import stored

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Arrow batches of this many rows keep long texts from piling up in a task.
BATCH_ROWS = "2000"
#: And of this many bytes at most, but for a longer row: a row may hold the pieces of some MB of text.
BATCH_BYTES = "4m"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def fold(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.drop_recurring(table(spark, folder, "documents"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.judge(table(spark, folder, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    field = toxicity.train(docs, labels, fold(4) != 2)
    return toxicity.score(docs, field).select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias("spans"),
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.link_groups(table(spark, folder, "documents"))


#: The rules the query applies.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    return url_filter.judge(table(spark, folder, "pages"), rules)


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    decoded = byte_bpe.coded_and_decoded(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op8_ngram_lm(spark: SparkSession, folder: str) -> DataFrame:
    out = ngram_lm.score(table(spark, folder, "documents"), fold(10) != 0)
    return out.withColumn("held_out", F.coalesce(fold(10) == 0, F.lit(False)))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring.spans(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labelled = secrets.known_forms(secrets.findings(docs.where(fold(4) != 2)))
    out = secrets.scan(docs, stored(labelled, "secret-findings"))
    return out.select(
        "doc_id",
        F.col("place").cast("long").alias("place"),
        F.col("nth").cast("long").alias("nth"),
        F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        "probability",
        "secret",
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows, vec_id = table(spark, folder, "embeddings"), F.col("vec_id")
    moved = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), vec_id % 100 == 0)


def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    out = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.link_groups(table(spark, folder, "documents"))


def hold_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, for the session: a batch is held on both sides of a Python worker's pipe."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _held(query):
    """Runs a query with Arrow batches of few rows and bytes."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        hold_batches(spark)
        return query(spark, folder)

    return run


QUERIES = {
    f.__name__: f if f in (op1_line_dedup, op2_quality_rules, op10_secret_scan) else _held(f)
    for f in (
        op1_line_dedup,
        op2_quality_rules,
        op3_toxicity,
        op4_decontamination,
        op5_jaccard_join,
        op6_url_filter,
        op7_byte_bpe,
        op8_ngram_lm,
        op9_substring_dedup,
        op10_secret_scan,
        op11_hard_negatives,
        op12_importance_resampling,
        op13_simhash,
    )
}
