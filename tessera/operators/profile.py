"""What the slots of a skeleton hold: value counts, representatives, dominance, entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT = ("chunk_id", "skeleton", "slot")


def skeleton_groups(distinct: DataFrame) -> DataFrame:
    """(chunk_id, skeleton, rows, distinct_tokens, first_row, first_pos)."""
    got = distinct.groupBy("chunk_id", "skeleton").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_tokens"), F.min(F.struct("first_row", "first_pos")).alias("f"))
    return got.select("chunk_id", "skeleton", "rows", "distinct_tokens", "f.first_row", "f.first_pos")


def slot_values(distinct: DataFrame) -> DataFrame:
    """(chunk_id, skeleton, slot, value, cnt, first_row, first_pos): how often each slot has each value, and where first."""
    cells = distinct.select("chunk_id", "skeleton", "n", "first_row", "first_pos", F.posexplode("subs").alias("slot", "value"))
    got = cells.groupBy(*SLOT, "value").agg(F.sum("n").alias("cnt"), F.min(F.struct("first_row", "first_pos")).alias("f"))
    return got.select(*SLOT, "value", "cnt", "f.first_row", "f.first_pos")


def representatives(values: DataFrame) -> DataFrame:
    """``values`` with ``rows``, ``uniq`` and ``is_rep``: counts that are no lower than the mean's floor and their neighbours' in value order.

    With a mean of one row a value nothing is representative.  The windows span the values of one slot of one chunk.
    """
    whole, ordered = Window.partitionBy(*SLOT), Window.partitionBy(*SLOT).orderBy("value")
    v = values.withColumns({"rows": F.sum("cnt").over(whole), "uniq": F.count(F.lit(1)).over(whole), "_before": F.lag("cnt").over(ordered), "_after": F.lead("cnt").over(ordered)})
    mean = F.floor(F.col("rows") / F.col("uniq"))
    peak = (F.col("cnt") >= mean) & (F.col("cnt") >= F.coalesce("_before", F.lit(0))) & (F.col("cnt") >= F.coalesce("_after", F.lit(0)))
    return v.withColumn("is_rep", (mean > 1) & peak).drop("_before", "_after")


def slot_stats(values: DataFrame) -> DataFrame:
    """(chunk_id, skeleton, slot, rows, uniq, n_reps, reps, rep_rows, dominance, entropy) for every slot."""
    v = representatives(values)
    p = F.col("cnt") / F.col("rows")
    return v.groupBy(*SLOT).agg(
        F.first("rows").alias("rows"),
        F.first("uniq").alias("uniq"),
        F.count_if("is_rep").alias("n_reps"),
        F.sort_array(F.collect_list(F.when(F.col("is_rep"), F.col("value")))).alias("reps"),
        F.sum(F.when(F.col("is_rep"), F.col("cnt")).otherwise(0)).alias("rep_rows"),
        F.round(F.sum(F.when(F.col("is_rep"), F.col("cnt")).otherwise(0)) / F.first("rows"), 6).alias("dominance"),
        F.round(F.abs(F.sum(p * F.log2(p))), 6).alias("entropy"),
    )


def best_slots(stats: DataFrame) -> DataFrame:
    """The slot of each skeleton to split on: fewest values, then most dominant, least entropy, first."""
    order = Window.partitionBy("chunk_id", "skeleton").orderBy("uniq", F.desc("rep_rows"), "entropy", "slot")
    return stats.where("uniq > 1").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
