"""Where lines come from: text files and table columns, as (chunk_id, row_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chunked(lines: DataFrame, chunk_lines: int) -> DataFrame:
    """(chunk_id, row_no, line): contiguous runs of ``chunk_lines`` rows."""
    return lines.select(F.floor(F.col("row_no") / chunk_lines).cast("int").alias("chunk_id"), "row_no", "line")


def row_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Rows from ``first`` up to, not with, ``last``; on an archive the row statistics of the files prune."""
    return lines.where((F.col("row_no") >= first) & (F.col("row_no") < last))


def text_lines(spark: SparkSession, path: str, chunk_lines: int) -> DataFrame:
    """Lines of text files, numbered over all files in path order.

    Only \\n ends a line, so carriage returns stay.  Rows get consecutive numbers
    from per-split counts (one small row a file split) and their order inside
    the split; no window spans the data.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("least"))
    before = splits.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = raw.join(F.broadcast(before.drop("n")), ["file", "block"])
    return chunked(placed.select((F.col("before") + F.col("nth") - F.col("least")).alias("row_no"), "line"), chunk_lines)


def column_lines(df: DataFrame, key: str, text: str, chunk_lines: int, most_lines: int = 100_000) -> DataFrame:
    """Lines of a text column: row_no is key * most_lines + the line's place, chunks hold chunk_lines keys.

    If a text has more lines, most_lines grows to the next power of ten that holds
    them, so that no two lines share a number; numbers beyond a long raise an error.
    """
    longest = df.agg(F.max(F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"))))).first()[0] or 0
    while most_lines <= longest:
        most_lines *= 10
    lines = df.select(F.col(key).cast("long").alias("k"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
    return lines.select(F.floor(F.col("k") / chunk_lines).cast("int").alias("chunk_id"), (F.col("k") * F.lit(most_lines).cast("long") + F.col("i")).alias("row_no"), "line")


def event_line() -> Column:
    """An event of the ``events`` table as a log line."""
    worker = F.concat(F.lit("[worker-"), (F.col("user_id") % 3).cast("string"), F.lit(":"), F.col("event_type"), F.lit("@"), F.floor("value").cast("string"), F.lit("]"))
    request = F.concat(F.lit("id "), F.col("event_id").cast("string"), F.lit(" /api/v1/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"))
    return F.concat_ws(" ", F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.concat(F.upper("event_type"), F.lit(" "), worker), request), "props")


def event_lines(events: DataFrame, chunk_lines: int = 4_000) -> DataFrame:
    return chunked(events.select(F.col("event_id").alias("row_no"), event_line().alias("line")), chunk_lines)
