"""Dictionaries and number encodings of the mined columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import SAMPLE_ROWS
from tessera.functions import numbers
from tessera.functions.joins import large
from tessera.operators.mine import plain_number

#: Digits that are certain to fit a long.
LONG_DIGITS = 18


def numeric_column() -> Column:
    """Whether a pattern column (fixed_len, is_num, lead0_or_big) is stored as numbers alone."""
    return F.col("is_num") & (F.col("fixed_len").between(1, LONG_DIGITS) | ~F.col("lead0_or_big"))


def dictionary(variables: DataFrame, rules: DataFrame, columns: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(chunk_id, id, token): dense ids from 0 in registration order.

    Patterns come first (skeletons by first appearance; in a split its representatives in byte order, its other
    values by first appearance, then the remainder), then the column values that are no plain numbers (by
    pattern, column, first appearance), then strings by first appearance, then tokens of single and constant skeletons.
    """
    chunk = Window.partitionBy("chunk_id")
    first = F.struct("first_row", "first_pos")
    heads = rules.groupBy("chunk_id", "skeleton").agg(F.min(first).alias("sk"))
    tagged = rules.join(large(heads), ["chunk_id", "skeleton"])
    if stats is not None:
        split_slots = rules.where("split_value is not null").select("chunk_id", "skeleton").distinct()
        reps = stats.join(large(split_slots), ["chunk_id", "skeleton"], "left_semi").select("chunk_id", "skeleton", F.explode("reps").alias("split_value"), F.lit(True).alias("is_rep")).distinct()
        tagged = tagged.join(large(reps), ["chunk_id", "skeleton", "split_value"], "left")
    else:
        tagged = tagged.withColumn("is_rep", F.lit(None).cast("boolean"))
    part = F.when(F.col("split_value").isNull(), 2).when(F.col("is_rep"), 0).otherwise(1)
    pats = tagged.where("mode not in ('single', 'const')").groupBy("chunk_id", "pattern").agg(F.min("sk").alias("sk"), F.min(part).alias("part"), F.min("split_value").alias("sv"), F.min(first).alias("at"))
    by_value = F.when(F.col("part") == 0, F.col("sv")).otherwise(F.lit(""))
    ranked = pats.withColumn("rank", F.row_number().over(chunk.orderBy("sk", "part", by_value, "at")))
    order = lambda block, rank, col, at: F.struct(F.lit(block).alias("block"), rank.cast("long").alias("rank"), col.cast("int").alias("col"), at.alias("at"))
    none = F.struct(F.lit(0).cast("long").alias("first_row"), F.lit(0).alias("first_pos"))
    at = F.struct(F.col("first_row"), F.col("first_pos"))
    one = ranked.select("chunk_id", F.col("pattern").alias("token"), order(1, F.col("rank"), F.lit(0), none).alias("o"))
    cells = rules.where("mode not in ('single', 'const')").select("chunk_id", "pattern", "first_row", "first_pos", F.posexplode("vals").alias("col", "v"))
    worded = cells.join(large(columns.where(~numeric_column()).select("chunk_id", "pattern", "col")), ["chunk_id", "pattern", "col"]).where(~plain_number(F.col("v")))
    two = worded.join(large(ranked.select("chunk_id", "pattern", "rank")), ["chunk_id", "pattern"]).select("chunk_id", F.col("v").alias("token"), order(2, F.col("rank"), F.col("col"), at).alias("o"))
    strings = variables.where("cls = 'str'").select("chunk_id", F.col("tok").alias("token"), F.col("row_no").alias("first_row"), F.col("pos").alias("first_pos"))
    three = strings.select("chunk_id", "token", order(3, F.lit(0), F.lit(0), at).alias("o"))
    four = tagged.where("mode in ('single', 'const')").select("chunk_id", F.col("tok").alias("token"), order(4, F.lit(0), F.lit(0), F.col("sk")).alias("o"))
    found = one.unionByName(two).unionByName(three).unionByName(four).groupBy("chunk_id", "token").agg(F.min("o").alias("o"))
    return found.select("chunk_id", (F.row_number().over(chunk.orderBy("o", "token")) - 1).cast("long").alias("id"), "token")


def string_dictionary(variables: DataFrame) -> DataFrame:
    """(chunk_id, id, token, n) of the plain strings alone, by first appearance."""
    seen = variables.where("cls = 'str'").groupBy("chunk_id", F.col("tok").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_no", "pos")).alias("at"))
    return seen.select("chunk_id", (F.row_number().over(Window.partitionBy("chunk_id").orderBy("at")) - 1).cast("long").alias("id"), "token", "n")


def instances(rows: DataFrame) -> DataFrame:
    """Pattern rows with inst_no, their number within the pattern."""
    return rows.withColumn("inst_no", (F.row_number().over(Window.partitionBy("chunk_id", "pattern").orderBy("row_no", "pos")) - 1).cast("long"))


def token_codes(rules: DataFrame, columns: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, tok, pattern, col, v, code) for each distinct token: twice a number, or twice a dictionary id plus 1."""
    cells = rules.where("mode not in ('single', 'const')").select("chunk_id", "tok", "pattern", F.posexplode("vals").alias("col", "v"))
    cells = cells.join(large(columns), ["chunk_id", "pattern", "col"]).withColumn("number", F.when(numeric_column() | plain_number(F.col("v")), F.expr("try_cast(v as bigint)")))
    words = cells.where("number is null").select("chunk_id", F.col("v").alias("token")).distinct().join(large(ids), ["chunk_id", "token"])
    joined = cells.join(large(words.withColumnRenamed("token", "v")), ["chunk_id", "v"], "left")
    return joined.select("chunk_id", "tok", "pattern", "col", "v", F.coalesce(F.col("number") * 2, F.col("id") * 2 + 1).alias("code"))


def matrix_codes(inst: DataFrame, rules: DataFrame, columns: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, pattern, col, inst_no, code): the matrices, one row a cell; codes are worked out once for each distinct token."""
    codes = token_codes(rules, columns, ids).select("chunk_id", "tok", "col", "code")
    return inst.select("chunk_id", "tok", "pattern", "inst_no").join(codes, ["chunk_id", "tok"]).select("chunk_id", "pattern", "col", "inst_no", "code")


def deltas(rows: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """``rows`` with ``delta``: the difference to the value before, the first value itself."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undeltas(rows: DataFrame, keys: list[str], order: list[str], delta: str = "delta") -> DataFrame:
    """The inverse: ``value`` as the running sum."""
    return rows.withColumn("value", F.sum(delta).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def mode_choice(rows: DataFrame, keys: list[str], seq: str, value: str = "value") -> DataFrame:
    """One row a column: whether its first SAMPLE_ROWS values are smaller as differences."""
    d = deltas(rows.where(F.col(seq) < SAMPLE_ROWS), keys, [seq], value)
    got = d.groupBy(*keys).agg(F.sum(F.abs(value)).alias("sum_values"), F.sum(F.abs("delta")).alias("sum_deltas"))
    return got.withColumn("mode", F.when(F.col("sum_deltas") < F.col("sum_values"), "delta").otherwise("raw"))


def joined_numbers(inst: DataFrame, columns: DataFrame) -> DataFrame:
    """(chunk_id, pattern, inst_no, joined): the values of patterns whose columns are all numbers of fixed lengths, side by side."""
    fixed = columns.groupBy("chunk_id", "pattern").agg(F.bool_and(F.col("is_num") & (F.col("fixed_len") > 0)).alias("ok"), F.count(F.lit(1)).alias("n_cols"))
    return inst.join(fixed.where("ok and n_cols >= 2").select("chunk_id", "pattern"), ["chunk_id", "pattern"]).select("chunk_id", "pattern", "inst_no", F.array_join("vals", "").alias("joined"))


def delta_eligible(joined: DataFrame) -> DataFrame:
    """One row a pattern of :func:`joined_numbers`: whether its matrix is stored as one differenced number.

    It is, if there are two rows or more, all parse as longs, and of the first SAMPLE_ROWS the largest step is under a tenth of the largest value.
    """
    n = joined.withColumn("value", F.when(F.length("joined") <= LONG_DIGITS, F.expr("try_cast(joined as bigint)")))
    w = Window.partitionBy("chunk_id", "pattern").orderBy("inst_no")
    n = n.withColumn("step", F.when(F.col("inst_no") < SAMPLE_ROWS, F.abs(F.col("value") - F.lag("value").over(w))))
    got = n.groupBy("chunk_id", "pattern").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("parsed"), F.max(F.when(F.col("inst_no") < SAMPLE_ROWS, F.col("value"))).alias("max_value"), F.max("step").alias("max_step"))
    ok = (F.col("rows") >= 2) & (F.col("rows") == F.col("parsed")) & (F.col("max_value") > 0) & (F.col("max_step") * 10 < F.col("max_value"))
    return got.select("chunk_id", "pattern", "rows", "max_value", "max_step", F.coalesce(ok, F.lit(False)).alias("eligible"))


def lsb_deltas(joined: DataFrame) -> DataFrame:
    """(chunk_id, pattern, inst_no, value, code): the base as it is, then differences with their sign in the lowest bit."""
    n = joined.select("chunk_id", "pattern", "inst_no", F.col("joined").cast("long").alias("value"))
    d = deltas(n, ["chunk_id", "pattern"], ["inst_no"])
    return d.select("chunk_id", "pattern", "inst_no", "value", F.when(F.col("inst_no") == 0, F.col("value")).otherwise(numbers.lsb_of_delta(F.col("delta"))).alias("code"))


def un_lsb(codes: DataFrame) -> DataFrame:
    """The inverse: (chunk_id, pattern, inst_no, value)."""
    d = codes.select("chunk_id", "pattern", "inst_no", F.when(F.col("inst_no") == 0, F.col("code")).otherwise(numbers.delta_of_lsb(F.col("code"))).alias("delta"))
    return undeltas(d, ["chunk_id", "pattern"], ["inst_no"]).drop("delta")
