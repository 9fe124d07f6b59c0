"""The bounded load as a stream: new files in batches of a set number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.files import CSV_OPTIONS


def stream_raw_csv(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Files of just this schema: a header that differs in names or order stops the stream.

    ``arrivals.load_arrivals`` binds each file by its own header and keeps what does not fit.
    """
    options = CSV_OPTIONS | {"multiLine": "true", "enforceSchema": "false", "maxFilesPerTrigger": str(files_per_batch)}
    return spark.readStream.schema(schema).options(**options).csv(folder)


def load_new_files(rows: DataFrame, target: str, progress: str) -> StreamingQuery:
    """Appends what has arrived to a Parquet folder and stops.

    ``progress`` records the files done, so a load cut short goes on where it stopped and
    loads no file twice.
    """
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
