"""Responses that come in pieces, and runs that take up new files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import in_order


def concatenated(chunks: DataFrame) -> DataFrame:
    """response_id and text: the deltas of a response (chunk_pos, delta) in order; null deltas are nothing."""
    return chunks.groupBy("response_id").agg(in_order(F.col("delta"), F.col("chunk_pos"), separator="").alias("text"))


def new_files(spark: SparkSession, folder: str, pattern: str = "*", text: bool = False) -> DataFrame:
    """A stream of the files of a folder; with a checkpoint each run gets only what came since the last."""
    if text:
        return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", pattern).load(folder)


def run_on_new(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop: the incremental form of a retried run."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
