"""Driver queries of the log engine, over lines made from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.functions import tokens as t
from tessera.operators import encode, mine, parse, profile
from tessera.plans import archive, workspace
from tessera.sources import lines as src


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_lines(_table(spark, sf_dir, "events"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines: a dictionary string, a composite with one dominant value, one with several, a number."""
    o = _table(spark, sf_dir, "orders")
    r = F.col("o_orderkey") % 100
    kind = F.when(r < 70, "a1").when(r < 80, "b2").when(r < 90, "c3").otherwise("d4")
    line = F.concat(
        F.lit("ord cust"), F.col("o_custkey").cast("string"), F.lit(" k="), kind, F.lit(":w"), (F.col("o_orderkey") % 11).cast("string"), F.lit("/z9"),
        F.lit(" p="), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string"),
    )
    return src.chunked(o.select(F.col("o_orderkey").alias("row_no"), line.alias("line")), 20_000)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.column_lines(_table(spark, sf_dir, "documents"), "doc_id", "text", 250)


def _variables(lines: DataFrame) -> DataFrame:
    return parse.variables(lines)


def _distinct(lines: DataFrame) -> DataFrame:
    return parse.distinct_composites(_variables(lines))


def _values(lines: DataFrame) -> DataFrame:
    return profile.slot_values(_distinct(lines))


def _settled(lines: DataFrame) -> DataFrame:
    """Distinct composites, written once: mining reads them on several branches, and they are far fewer than the lines."""
    return workspace.settle(_distinct(lines), "distinct")


def _rules(lines: DataFrame) -> DataFrame:
    """Mined rules, written once: they are read by several branches of a plan."""
    return workspace.settle(mine.mined(_settled(lines)), "rules")


def tokenize_documents(spark, sf_dir):
    toks = parse.tokenised(document_lines(spark, sf_dir))
    gaps = F.size(F.filter("toks", lambda x: x.rlike(r"^(?U)\s$")))
    return toks.select("row_no", F.size("toks").alias("n_tokens"), gaps.alias("n_gaps"), F.length(F.array_join("toks", "")).alias("n_chars"))


def token_class_counts(spark, sf_dir):
    toks = parse.tokenised(event_lines(spark, sf_dir)).select(F.explode("toks").alias("tok"))
    distinct = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(t.token_class(F.col("tok")).alias("cls")).agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct"))


def template_topk(spark, sf_dir):
    rows = parse.templated(event_lines(spark, sf_dir))
    return rows.groupBy("template").agg(F.count(F.lit(1)).alias("n_lines")).orderBy(F.desc("n_lines"), "template").limit(10)


def template_table(spark, sf_dir):
    return parse.template_ids(document_lines(spark, sf_dir).where("line <> ''"))[0]


def line_templates(spark, sf_dir):
    return parse.template_ids(event_lines(spark, sf_dir))[1]


def template_restore(spark, sf_dir):
    templates, rows = parse.template_ids(event_lines(spark, sf_dir))
    restored = rows.join(templates.select("chunk_id", "template_id", "template"), ["chunk_id", "template_id"], "left")
    return restored.select("chunk_id", "row_no", F.coalesce("template", F.concat(F.lit("<INVALID_ID:"), F.col("template_id").cast("string"), F.lit(">"))).alias("template"))


def template_usage(spark, sf_dir):
    """Templates of all event lines, and whether lines refer to them."""
    templates, rows = parse.template_ids(event_lines(spark, sf_dir))
    report = archive.reference_report(templates, rows, "template_id")
    return report.select("chunk_id", "template_id", (F.col("state") == "used").alias("used"))


def _archived_orders(spark, sf_dir) -> str:
    return _archived(spark, order_lines(spark, sf_dir))


def dictionary_usage(spark, sf_dir):
    """Ids that the string marks refer to against the chunk's string dictionary of purchases: used, unused and missing ones."""
    lines = event_lines(spark, sf_dir)
    every = encode.string_dictionary(_variables(lines))
    bought = encode.string_dictionary(_variables(lines.where(F.contains("line", F.lit("PURCHASE")))))
    clicked = encode.string_dictionary(_variables(lines.where(F.contains("line", F.lit("CLICK")))))
    ids = every.join(bought.select("chunk_id", "token"), ["chunk_id", "token"], "left_semi")
    used = every.join(clicked.select("chunk_id", "token"), ["chunk_id", "token"], "left_semi")
    return archive.reference_report(ids, used, "id")


def pattern_uses(spark, sf_dir):
    """How often each pattern of an archive occurs, also those that only the dictionary holds."""
    return archive.pattern_uses(_archived_orders(spark, sf_dir), spark)


def invalid_templates(spark, sf_dir):
    """Lines of an archive whose templates of view events are gone: they read as invalid ids, the others as they were."""
    path = _archived(spark, event_lines(spark, sf_dir))
    lines, templates = archive.table(spark, path, "lines"), archive.table(spark, path, "templates")
    left = templates.where(~F.exists("literals", lambda x: F.contains(x, F.lit("VIEW"))))
    rows = lines.join(left, ["chunk_id", "template_id"], "left")
    shown = F.when(F.col("literals").isNull(), F.concat(F.lit("<INVALID_ID:"), F.col("template_id").cast("string"), F.lit(">"))).otherwise(F.array_join("literals", "<>"))
    return rows.select("chunk_id", "row_no", shown.alias("shown"))


def text_source(spark, sf_dir):
    """Event lines written as text files, and read back as numbered lines of chunks."""
    path = workspace.fresh_path(spark, "text")
    ordered = event_lines(spark, sf_dir).repartitionByRange("row_no").sortWithinPartitions("row_no")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
    return src.text_lines(spark, path, 4_000)


def row_range(spark, sf_dir):
    """Rows 1,000 up to 3,000 of an archive."""
    return src.row_range(archive.read(spark, _archived(spark, event_lines(spark, sf_dir))), 1_000, 3_000)


def sampled_differences(spark, sf_dir):
    """Random lines (the sample is the feature) compared with an archive in which every purchase was changed: one row a kind."""
    lines = event_lines(spark, sf_dir)
    back = archive.read(spark, _archived(spark, lines)).withColumn("line", F.replace("line", F.lit("PURCHASE"), F.lit("SALE")))
    found = archive.sampled_differences(lines, back, 400)
    kind = F.when(F.contains("line", F.lit("PURCHASE")) | F.contains("line", F.lit("SALE")), "changed").otherwise("other")
    return found.select(kind.alias("kind"), "side").distinct()


def many_slots_plan(spark, sf_dir):
    """Split plan of line items whose tokens have 17 slots, with long numbers, many representatives and dominated slots."""
    li = _table(spark, sf_dir, "lineitem")
    n = lambda c: F.col(c).cast("long").cast("string")
    date = [F.date_format("l_shipdate", f) for f in ("yyyy", "MM", "dd")]
    rests = [(F.col("l_orderkey") % k).cast("string") for k in (2, 3, 5, 7, 11)]
    small = F.concat_ws(":", n("l_orderkey"), n("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus"), *date, n("l_quantity"), *rests, n("l_partkey"), n("l_suppkey"), F.lpad(n("l_orderkey"), 20, "0"), F.lit("end1"))
    many = F.concat(F.lit("q="), (F.col("l_partkey") % 45).cast("string"), F.lit("/s"), (F.col("l_suppkey") % 50).cast("string"))
    kind = F.when(F.col("l_orderkey") % 100 < 70, "a1").otherwise(F.concat(F.lit("b"), (F.col("l_orderkey") % 100).cast("string")))
    line = F.concat(F.lit("item "), small, F.lit(" "), many, F.lit(" m="), kind, F.lit(":w"), (F.col("l_orderkey") % 11).cast("string"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = src.chunked(li.select(key.alias("row_no"), line.alias("line")), 200_000)
    plan = mine.split_plan(profile.slot_values(_settled(lines)))
    return plan.select("chunk_id", "skeleton", "rows", "n_varying", "mode", "best_slot", F.array_join("split_values", "|").alias("split_values"))


def length_keys(spark, sf_dir):
    """Number columns by the letter that names their length, and back."""
    nums = parse.number_columns(_variables(order_lines(spark, sf_dir)))
    keyed = nums.groupBy(t.key_of_length(F.col("len")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.select("key", t.length_of_key(F.col("key")).alias("len"), "n")


def number_columns_by_length(spark, sf_dir):
    return parse.number_columns(_variables(order_lines(spark, sf_dir))).select("chunk_id", "len", "seq", "value")


def number_delta(spark, sf_dir):
    nums = parse.number_columns(_variables(order_lines(spark, sf_dir)))
    return encode.deltas(nums, ["chunk_id", "len"], ["seq"]).select("chunk_id", "len", "seq", "delta")


def number_undelta(spark, sf_dir):
    nums = parse.number_columns(_variables(order_lines(spark, sf_dir)))
    d = encode.deltas(nums, ["chunk_id", "len"], ["seq"]).select("chunk_id", "len", "seq", "delta")
    return encode.undeltas(d, ["chunk_id", "len"], ["seq"]).select("chunk_id", "len", "seq", F.col("value").cast("long").alias("value"))


def number_leb_size(spark, sf_dir):
    nums = parse.number_columns(_variables(order_lines(spark, sf_dir)))
    d = encode.deltas(nums, ["chunk_id", "len"], ["seq"])
    sums = d.groupBy("chunk_id", "len").agg(F.sum(numbers.unsigned_leb_size(F.col("value"))).alias("raw_bytes"), F.sum(numbers.signed_leb_size(F.col("delta"))).alias("delta_bytes"))
    return sums


def number_mode_choice(spark, sf_dir):
    nums = parse.number_columns(_variables(order_lines(spark, sf_dir)))
    return encode.mode_choice(nums, ["chunk_id", "len"], "seq").select("chunk_id", "len", "sum_values", "sum_deltas", "mode")


def simple_var_dictionary(spark, sf_dir):
    return encode.string_dictionary(_variables(order_lines(spark, sf_dir)))


def dict_lookup(spark, sf_dir):
    v = _variables(order_lines(spark, sf_dir))
    ids = encode.string_dictionary(v)
    return v.where("cls = 'str'").join(ids.select("chunk_id", "id", F.col("token").alias("tok")), ["chunk_id", "tok"]).select("chunk_id", "row_no", "pos", "id")


def positional_join(spark, sf_dir):
    """The n-th string mark of a chunk meets the n-th id of its stream."""
    v = _variables(order_lines(spark, sf_dir)).where("cls = 'str'")
    order = Window.partitionBy("chunk_id").orderBy("row_no", "pos")
    marks = v.select("chunk_id", "row_no", "pos", (F.row_number().over(order) - 1).cast("long").alias("nth"))
    ids = encode.string_dictionary(v)
    stream = v.join(ids.select("chunk_id", "id", F.col("token").alias("tok")), ["chunk_id", "tok"]).select("chunk_id", "id", (F.row_number().over(order) - 1).cast("long").alias("nth"))
    back = ids.select("chunk_id", "id", "token")
    return marks.join(stream, ["chunk_id", "nth"]).join(back, ["chunk_id", "id"]).select("chunk_id", "row_no", "pos", "token")


def skeleton_groups(spark, sf_dir):
    return profile.skeleton_groups(_distinct(event_lines(spark, sf_dir)))


def slot_value_counts(spark, sf_dir):
    return _values(event_lines(spark, sf_dir)).select(*profile.SLOT, "value", "cnt")


def slot_stats(spark, sf_dir):
    return profile.slot_stats(_values(event_lines(spark, sf_dir))).select(*profile.SLOT, "rows", "uniq", "n_reps", "dominance", "entropy")


def representative_values(spark, sf_dir):
    return profile.representatives(_values(event_lines(spark, sf_dir))).where("is_rep").select(*profile.SLOT, "value", "cnt")


def best_slot(spark, sf_dir):
    return profile.best_slots(profile.slot_stats(_values(event_lines(spark, sf_dir)))).select("chunk_id", "skeleton", "slot", "uniq", "n_reps")


def constant_slots(spark, sf_dir):
    return mine.profile_constants(_values(order_lines(spark, sf_dir)))


def split_plan(spark, sf_dir):
    plan = mine.split_plan(profile.slot_values(_settled(order_lines(spark, sf_dir))))
    return plan.select("chunk_id", "skeleton", "rows", "n_varying", "mode", "best_slot", F.array_join("split_values", "|").alias("split_values"))


def split_rows_semi(spark, sf_dir):
    d = _settled(order_lines(spark, sf_dir))
    rows = mine.assigned(d, mine.split_plan(profile.slot_values(d)))
    return rows.where("split_value is not null").select("chunk_id", "tok", "split_value", "n")


def remainder_rows_anti(spark, sf_dir):
    d = _settled(order_lines(spark, sf_dir))
    rows = mine.assigned(d, mine.split_plan(profile.slot_values(d)))
    return rows.where("mode like 'split%' and split_value is null").select("chunk_id", "tok", "n")


def split_constant_fold(spark, sf_dir):
    d = _settled(order_lines(spark, sf_dir))
    v = profile.slot_values(d)
    fills = mine.group_fills(mine.assigned(d, mine.split_plan(v)), v)
    shown = F.array_join(F.transform("fill", lambda x: F.coalesce(x, F.lit(t.HOLE))), "|")
    return fills.select("chunk_id", "skeleton", "split_value", "mode", shown.alias("fill"))


def final_patterns(spark, sf_dir):
    rules = mine.mined(_settled(order_lines(spark, sf_dir)))
    return rules.groupBy("chunk_id", "pattern", "mode").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_tokens"), F.min(F.size("vals")).alias("n_cols"))


def pattern_column_types(spark, sf_dir):
    return mine.pattern_columns(mine.mined(_settled(event_lines(spark, sf_dir))))


def _event_instances(spark, sf_dir):
    # Tokens are cut out once; mining and instances start from the table.
    comps = workspace.settle(_variables(event_lines(spark, sf_dir)).where("cls = 'comp'"), "variables")
    rules = workspace.settle(mine.mined(workspace.settle(parse.distinct_composites(comps), "distinct")), "rules")
    return rules, encode.instances(mine.pattern_rows(comps, rules))


def pattern_instance_join(spark, sf_dir):
    """Occurrences of mined patterns joined with their values, rendered again."""
    rules, inst = _event_instances(spark, sf_dir)
    heads = rules.groupBy("chunk_id", "pattern").agg(F.first("lits").alias("lits"), F.first("fill").alias("fill"))
    nth = lambda i: F.size(F.filter(F.slice("fill", 1, i + 1), lambda f: f.isNull()))
    words = F.transform("fill", lambda f, i: F.coalesce(f, F.get("vals", nth(i) - 1)))
    # A value list is rendered once, however often it occurs.
    forms = rules.where(F.size("vals") > 0).select("chunk_id", F.col("tok").alias("form"), "pattern", "vals").join(heads, ["chunk_id", "pattern"])
    rendered = forms.select("chunk_id", "form", t.fill(F.col("lits"), words).alias("tok"))
    return inst.select("chunk_id", "pattern", "inst_no", F.col("tok").alias("form")).join(rendered, ["chunk_id", "form"]).select("chunk_id", "pattern", "inst_no", "tok")


def concat_fixed_width(spark, sf_dir):
    rules, inst = _event_instances(spark, sf_dir)
    return encode.joined_numbers(inst, mine.pattern_columns(rules))


def delta_eligibility(spark, sf_dir):
    rules, inst = _event_instances(spark, sf_dir)
    return encode.delta_eligible(encode.joined_numbers(inst, mine.pattern_columns(rules)))


def lsb_delta_encode(spark, sf_dir):
    rules, inst = _event_instances(spark, sf_dir)
    return encode.lsb_deltas(encode.joined_numbers(inst, mine.pattern_columns(rules))).select("chunk_id", "pattern", "inst_no", "code")


def lsb_delta_decode(spark, sf_dir):
    rules, inst = _event_instances(spark, sf_dir)
    back = encode.un_lsb(encode.lsb_deltas(encode.joined_numbers(inst, mine.pattern_columns(rules))))
    return back.select("chunk_id", "pattern", "inst_no", F.col("value").cast("long").alias("value"))


def _order_rules(spark, sf_dir):
    """Variables, rules, columns and dictionary of the order lines, each written once."""
    v = workspace.settle(_variables(order_lines(spark, sf_dir)), "variables")
    d = workspace.settle(parse.distinct_composites(v), "distinct")
    values = workspace.settle(profile.slot_values(d), "slots")
    rules = workspace.settle(mine.mined(d, values=values), "rules")
    columns = mine.pattern_columns(rules)
    return v, rules, columns, encode.dictionary(v, rules, columns, profile.slot_stats(values))


def pattern_dictionary(spark, sf_dir):
    return _order_rules(spark, sf_dir)[-1]


def matrix_codes(spark, sf_dir):
    v, rules, columns, ids = _order_rules(spark, sf_dir)
    return encode.matrix_codes(encode.instances(mine.pattern_rows(v, rules)), rules, columns, workspace.settle(ids, "dictionary"))


def letters_of_id(spark, sf_dir):
    keys = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return keys.select("id", numbers.letters_of_id(F.col("id")).alias("letters"))


def id_of_letters(spark, sf_dir):
    words = _table(spark, sf_dir, "events").select(F.col("event_type").alias("letters")).where("letters rlike '^[a-z]+$'").distinct()
    return words.select("letters", numbers.id_of_letters(F.col("letters")).alias("id"))


def _archived(spark, lines: DataFrame) -> str:
    path = workspace.fresh_path(spark, "archive")
    archive.write(lines, path)
    return path


def roundtrip_diff(spark, sf_dir):
    """Lines and differing lines of each text table after archiving and restoring, all in one archive."""
    pages = src.column_lines(_table(spark, sf_dir, "pages"), "page_id", "html", 100)
    sources = {"documents": document_lines(spark, sf_dir), "events": event_lines(spark, sf_dir), "orders": order_lines(spark, sf_dir), "pages": pages}
    lines = None
    for i, df in enumerate(sources.values()):
        moved = df.select((F.col("chunk_id") * len(sources) + i).alias("chunk_id"), (F.col("row_no") * len(sources) + i).alias("row_no"), "line")
        lines = moved if lines is None else lines.unionByName(moved)
    back = archive.read(spark, _archived(spark, lines))
    # Both sides are counted in one pass: a line that came back whole has none left over.
    each = back.select("row_no", "line", F.lit(1).alias("n"), F.lit(1).alias("d")).unionByName(lines.select("row_no", F.coalesce("line", F.lit("")).alias("line"), F.lit(0).alias("n"), F.lit(-1).alias("d")))
    counted = each.groupBy("row_no", "line").agg(F.sum("n").alias("n"), F.abs(F.sum("d")).alias("d"))
    name = F.element_at(F.array(*map(F.lit, sources)), (F.col("row_no") % len(sources) + 1).cast("int"))
    return counted.groupBy(name.alias("source")).agg(F.sum("n").alias("n_lines"), F.sum("d").alias("n_differ"))


def archive_size_by_stream(spark, sf_dir):
    return archive.sizes(_archived_orders(spark, sf_dir), spark)


def archive_read_chunk(spark, sf_dir):
    """One chunk of an archive, by partition pruning."""
    return archive.read(spark, _archived(spark, event_lines(spark, sf_dir)), [1])


def legacy_archive_roundtrip(spark, sf_dir):
    """Portable per-chunk archives written and read back."""
    from tessera.sources import portable

    return portable.read_archives(portable.write_archives(order_lines(spark, sf_dir)))


def legacy_leb_decode(spark, sf_dir):
    """The number columns of portable archives, decoded from their bytes."""
    from tessera.sources import portable

    return portable.read_numbers(portable.write_archives(order_lines(spark, sf_dir)))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    template_topk, tokenize_documents, token_class_counts, template_table, line_templates, template_restore, template_usage,
    number_columns_by_length, number_delta, number_undelta, number_leb_size, number_mode_choice, simple_var_dictionary, dict_lookup, positional_join,
    skeleton_groups, slot_value_counts, slot_stats, representative_values, best_slot, constant_slots, split_plan, split_rows_semi, remainder_rows_anti,
    split_constant_fold, final_patterns, pattern_column_types, pattern_instance_join, concat_fixed_width, delta_eligibility, lsb_delta_encode, lsb_delta_decode,
    pattern_dictionary, matrix_codes, letters_of_id, id_of_letters, roundtrip_diff, archive_size_by_stream, archive_read_chunk, legacy_archive_roundtrip, legacy_leb_decode,
    dictionary_usage, pattern_uses, invalid_templates, text_source, row_range, sampled_differences, many_slots_plan, length_keys,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}
