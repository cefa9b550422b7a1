"""Structured Streaming ingestion (an extension): each micro-batch of log files becomes chunks of their own.

Chunks do not depend on each other, so a batch is archived by itself, in a folder
named after it; a batch that is run again overwrites its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import Settings
from tessera.plans import archive
from tessera.sources import lines as src


def archive_stream(spark: SparkSession, source: str, target: str, state: str, settings: Settings = Settings()) -> StreamingQuery:
    """Archive the lines of text files as they arrive in ``source``."""
    raw = spark.readStream.option("lineSep", "\n").text(source).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("nth", F.monotonically_increasing_id())
        splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("least"))
        before = splits.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        placed = rows.join(F.broadcast(before), ["file", "block"])
        numbered = placed.select((F.col("before") + F.col("nth") - F.col("least")).alias("row_no"), "line")
        archive.write(src.chunked(numbered, settings.chunk_lines), f"{target}/batch={batch_id:08d}", settings)

    return raw.writeStream.foreachBatch(store).option("checkpointLocation", state).start()


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    """(batch, chunk_id, row_no, line) of all archived batches, in one plan however many there are; none is an empty table.

    The folders ``batch=n`` are a partition column of every table; a batch's chunks get numbers that no other batch has, for the joins.
    """
    return archive.read_all(spark, target, "batch")
