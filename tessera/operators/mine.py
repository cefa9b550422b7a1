"""Pattern mining: fold constant slots, split skeletons on dominant values, bind the rest as columns.

A pattern is (literals, fill): fill holds a word for a folded slot and null for an
open one, so nothing is read back out of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import FOLD_BELOW, NUMBER_DIGITS, Settings
from tessera.functions import tokens as t
from tessera.functions.joins import large
from tessera.operators import profile

GROUP = ("chunk_id", "skeleton", "split_value")


def split_plan(values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a skeleton: rows, n_varying, mode, best_slot, split_values.

    Modes: 'single' (one occurrence), 'const' (all slots constant), 'one' (one varies),
    'nosplit', 'split_all' (on every value) and 'split_reps' (on representatives).
    """
    stats = profile.slot_stats(values)
    best = profile.best_slots(stats).select("chunk_id", "skeleton", F.col("slot").alias("best_slot"), F.col("uniq").alias("best_uniq"), "n_reps", "reps", "rep_rows")
    heads = stats.groupBy("chunk_id", "skeleton").agg(F.first("rows").alias("rows"), F.count_if(F.col("uniq") > 1).alias("n_varying"))
    plan = heads.join(large(best), ["chunk_id", "skeleton"], "left")
    weak = (F.col("n_reps") == 0) | (F.col("n_reps") >= settings.most_representatives) | (F.col("rep_rows") / F.col("rows") <= settings.least_dominance)
    mode = (
        F.when(F.col("rows") == 1, "single")
        .when(F.col("n_varying") == 0, "const")
        .when(F.col("n_varying") == 1, "one")
        .when(weak, "nosplit")
        .when(F.col("best_uniq") <= settings.split_all_up_to, "split_all")
        .otherwise("split_reps")
    )
    plan = plan.select("chunk_id", "skeleton", "rows", "n_varying", mode.alias("mode"), "best_slot", "reps")
    split = F.col("mode").startswith("split")
    # The values of a slot that is split on all of them: at most split_all_up_to.
    every = values.join(large(plan.where("mode = 'split_all'").select("chunk_id", "skeleton", F.col("best_slot").alias("slot"))), [*profile.SLOT]).groupBy("chunk_id", "skeleton").agg(F.sort_array(F.collect_list("value")).alias("every"))
    plan = plan.join(large(every), ["chunk_id", "skeleton"], "left")
    return plan.select("chunk_id", "skeleton", "rows", "n_varying", "mode", F.when(split, F.col("best_slot")).alias("best_slot"), F.when(split, F.coalesce("every", "reps")).alias("split_values"))


def assigned(distinct: DataFrame, plan: DataFrame) -> DataFrame:
    """Distinct tokens with mode, best_slot, n_varying and their split value (null: no split, or the remainder)."""
    rows = distinct.join(large(plan.select("chunk_id", "skeleton", "mode", "n_varying", "best_slot", "split_values")), ["chunk_id", "skeleton"])
    own = F.get("subs", F.col("best_slot"))
    return rows.withColumn("split_value", F.when(F.array_contains("split_values", own), own)).drop("split_values")


def group_fills(tokens: DataFrame, values: DataFrame) -> DataFrame:
    """(chunk_id, skeleton, split_value, mode, fill): the word of each folded slot of each group, null for open slots.

    Slots that are constant over the whole skeleton are folded everywhere; slots that are constant in the rows of one
    split value only there (while fewer than FOLD_BELOW columns are left); the remainder is not folded further.
    """
    constant = profile_constants(values)
    cells = tokens.select(*GROUP, "mode", "n_varying", "best_slot", F.posexplode("subs").alias("slot", "value"))
    ends = cells.groupBy(*GROUP, "mode", "n_varying", "best_slot", "slot").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ends = ends.join(large(constant), [*profile.SLOT], "left")
    local = F.col("split_value").isNotNull() & ((F.col("slot") == F.col("best_slot")) | (F.col("n_varying") - 1 < FOLD_BELOW)) & (F.col("lo") == F.col("hi"))
    word = F.coalesce("constant", F.when(local, F.col("lo")))
    got = ends.groupBy(*GROUP, "mode").agg(F.sort_array(F.collect_list(F.struct("slot", word.alias("word")))).alias("f"))
    return got.select(*GROUP, "mode", F.col("f.word").alias("fill"))


def profile_constants(values: DataFrame) -> DataFrame:
    """(chunk_id, skeleton, slot, constant) of the slots with one value."""
    return values.groupBy(*profile.SLOT).agg(F.min("value").alias("constant"), F.max("value").alias("_hi")).where("constant = _hi").drop("_hi")


def token_rules(tokens: DataFrame, fills: DataFrame) -> DataFrame:
    """(chunk_id, tok, skeleton, split_value, mode, n, first_row, first_pos, lits, fill, pattern, vals): each distinct token's pattern and open values."""
    rows = tokens.withColumn("_s", F.coalesce("split_value", F.lit(""))).join(large(fills.select("chunk_id", "skeleton", F.coalesce("split_value", F.lit("")).alias("_s"), "fill")), ["chunk_id", "skeleton", "_s"])
    left = F.filter(F.zip_with("subs", "fill", lambda s, f: F.when(f.isNull(), s)), lambda x: x.isNotNull())
    lits = t.literals(F.col("tok"))
    return rows.select("chunk_id", "tok", "skeleton", "split_value", "mode", "n", "first_row", "first_pos", lits.alias("lits"), "fill", t.fill(lits, F.col("fill")).alias("pattern"), left.alias("vals"))


def mined(distinct: DataFrame, settings: Settings = Settings(), values: DataFrame | None = None) -> DataFrame:
    """Rules for all distinct composite tokens; see :func:`token_rules`.  ``values``: their slot values, where these are at hand."""
    values = profile.slot_values(distinct) if values is None else values
    tokens = assigned(distinct, split_plan(values, settings))
    return token_rules(tokens, group_fills(tokens, values))


def pattern_columns(rules: DataFrame) -> DataFrame:
    """(chunk_id, pattern, col, fixed_len, is_num, lead0_or_big) of the open columns of each pattern.

    fixed_len is -1 where lengths differ; lead0_or_big: some value has a leading zero or more than 15 digits.
    """
    cells = rules.where("mode not in ('single', 'const')").select("chunk_id", "pattern", F.posexplode("vals").alias("col", "v"))
    length = F.length("v")
    return cells.groupBy("chunk_id", "pattern", "col").agg(
        F.when(F.min(length) == F.max(length), F.max(length)).otherwise(F.lit(-1)).alias("fixed_len"),
        F.bool_and(t.is_numeric(F.col("v"))).alias("is_num"),
        F.bool_or((length > NUMBER_DIGITS) | ((length > 1) & F.startswith("v", F.lit("0")))).alias("lead0_or_big"),
    )


def pattern_rows(variables: DataFrame, rules: DataFrame) -> DataFrame:
    """(chunk_id, row_no, pos, tok, pattern, vals) of every composite occurrence whose pattern has open columns."""
    open_rules = rules.where(F.size("vals") > 0).select("chunk_id", "tok", "pattern", "vals")
    return variables.where("cls = 'comp'").join(open_rules, ["chunk_id", "tok"]).select("chunk_id", "row_no", "pos", "tok", "pattern", "vals")


def plain_number(v: Column) -> Column:
    """At most 15 digits and no leading zero."""
    return t.is_numeric(v) & (F.length(v) <= NUMBER_DIGITS) & ((F.length(v) == 1) | ~F.startswith(v, F.lit("0")))
