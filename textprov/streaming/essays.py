"""The row-wise operators over essays that keep arriving.

Filters, formats and scoring hold no state, so they run on a stream as they are.
Operators that count, sort or batch rows need a whole table and do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textprov.sources.readers import ESSAYS


def essay_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Essays from parquet files as they appear in a folder."""
    return (
        spark.readStream.schema(ESSAYS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived to a parquet folder, each row once, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
