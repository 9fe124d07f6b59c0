"""CSV records out of split files, quoted line breaks included.

A line break ends a record where the number of quotes before it is even. Spark splits a file
into blocks and each block into lines; the quotes of the blocks before decide how a block
begins.

1. Lines of a block are taken in chunks. Quotes are counted per chunk; a running sum over a
   file's chunks, a row each, says whether a chunk begins inside quotes.
2. Within a chunk a running sum over the lines marks where records begin. Chunks have a
   bounded number of lines and are dealt to as many tasks as the text asks for, so neither
   a group nor a task grows with the file or its blocks.
3. What a chunk's boundary cuts, two pieces a chunk at most, is put together afterwards.

Files are taken to follow RFC 4180: a quote occurs in quoted fields only, doubled inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import stored

#: Lines of a chunk, as a power of two; text dealt to a task, on average.
CHUNK_BITS, TASK_BYTES = 13, 8 << 20
#: Records of later chunks of a block are numbered from multiples of this power of two.
NUMBER_BITS = 20


def _quotes(c: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, '"', ""))).cast("long")


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, block (where it starts), line (in order within a block), chunk (of lines), text."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("text"),
        _quotes("value").alias("quotes"),
    ).withColumn("chunk", F.shiftright("line", CHUNK_BITS))


def chunk_starts(lines: DataFrame) -> DataFrame:
    """file, block, chunk, place (of the chunk in its block), size (bytes), inside: 1 where the chunk begins inside quotes."""
    size = F.sum(F.octet_length("text").cast("long") + 1)
    chunks = lines.groupBy("file", "block", "chunk").agg(F.sum("quotes").alias("quotes"), size.alias("size"))
    before = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0).cast("long"))
    place = F.col("chunk") - F.min("chunk").over(Window.partitionBy("file", "block"))
    return chunks.select("file", "block", "chunk", place.alias("place"), "size", inside.alias("inside"))


def _joined(*order: str) -> Column:
    """The texts of a group as one, with their line breaks."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "\n")


def csv_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, block, record, text: every record of the files with its line breaks, headers included.

    ``block`` and ``record`` give the order within a file. Blank lines between records and a
    carriage return that ends a record are left out. A quote that is never closed makes one
    record of all that follows. Records are written to the shared folder once.
    """
    lines = _lines(spark, paths)
    starts = stored(chunk_starts(lines), "csv-chunks")
    tasks = int((starts.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES) + 1
    # blocks depend on the session's split sizes; were they cut anew meanwhile, this stops
    torn = F.raise_error(F.lit("the files or their splits changed while they were read"))
    inside = F.coalesce("inside", torn.cast("long"))
    lines = lines.join(starts.drop("size"), ["file", "block", "chunk"], "left").withColumn("inside", inside)
    lines = lines.repartition(tasks, "file", "block", "chunk")  # AQE would put small shuffled rows together, large when read
    by_line = Window.partitionBy("file", "block", "chunk").orderBy("line")
    earlier = F.coalesce(F.sum("quotes").over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = ((F.col("inside") + F.col("earlier")) % 2 == 0).cast("long")
    upto = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("earlier", earlier).withColumn("nth", F.sum(begins).over(upto))
    pieces = numbered.groupBy("file", "block", "chunk", "nth").agg(
        (F.shiftleft(F.first("place"), NUMBER_BITS) + F.col("nth")).alias("record"),
        _joined("line").alias("text"),
        (F.sum("quotes") % 2).alias("open"),
    )
    pieces = stored(pieces.drop("chunk"), "csv-pieces")

    whole = (F.col("nth") > 0) & (F.col("open") == 0)
    in_order = Window.partitionBy("file").orderBy("block", "record")
    cut = pieces.where(~whole).withColumn("number", F.sum((F.col("nth") > 0).cast("long")).over(in_order))
    glued = cut.groupBy("file", "number").agg(
        F.min(F.struct("block", "record")).alias("place"), _joined("block", "record").alias("text")
    )
    glued = glued.select("file", "place.block", "place.record", "text")
    records = pieces.where(whole).select("file", "block", "record", "text").unionByName(glued)
    text = F.regexp_replace("text", r"\r\z", "")
    return records.withColumn("text", text).where("text <> ''")
