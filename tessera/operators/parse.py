"""Lines to templates and variable streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import tokens as t


def tokenised(lines: DataFrame) -> DataFrame:
    """(chunk_id, row_no, toks)."""
    return lines.select("chunk_id", "row_no", t.tokens(F.coalesce("line", F.lit(""))).alias("toks"))


def templated(lines: DataFrame) -> DataFrame:
    """(chunk_id, row_no, template)."""
    return tokenised(lines).select("chunk_id", "row_no", t.template(F.col("toks")).alias("template"))


def variables(lines: DataFrame) -> DataFrame:
    """(chunk_id, row_no, pos, cls, tok): only tokens that vary are exploded."""
    return tokenised(lines).select("chunk_id", "row_no", F.inline(t.variables(F.col("toks"))))


def template_ids(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates (chunk_id, template_id, template, lines) numbered by first appearance, and (chunk_id, row_no, template_id)."""
    rows = templated(lines)
    seen = rows.groupBy("chunk_id", "template").agg(F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("lines"))
    number = F.row_number().over(Window.partitionBy("chunk_id").orderBy("first_row")) - 1
    templates = seen.select("chunk_id", number.cast("long").alias("template_id"), "template", "lines")
    return templates, rows.join(templates, ["chunk_id", "template"]).select("chunk_id", "row_no", "template_id")


def number_columns(variables: DataFrame) -> DataFrame:
    """(chunk_id, len, seq, row_no, pos, value): one column of integers for each digit length."""
    order = Window.partitionBy("chunk_id", "len").orderBy("row_no", "pos")
    nums = variables.where("cls = 'num'").select("chunk_id", F.length("tok").alias("len"), "row_no", "pos", F.col("tok").cast("long").alias("value"))
    return nums.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def distinct_composites(variables: DataFrame) -> DataFrame:
    """(chunk_id, tok, n, first_row, first_pos, skeleton, subs): regexes run once for each distinct token."""
    comp = variables.where("cls = 'comp'").groupBy("chunk_id", "tok").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_no", "pos")).alias("first"))
    return comp.select("chunk_id", "tok", "n", F.col("first.row_no").alias("first_row"), F.col("first.pos").alias("first_pos"), t.skeleton(F.col("tok")).alias("skeleton"), t.sub_words(F.col("tok")).alias("subs"))
