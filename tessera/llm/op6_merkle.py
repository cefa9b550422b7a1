"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections, in SQL expressions alone.

A paragraph is a line with its line end.  It is cut into leaves after words that end in ``.``, ``!`` or ``?`` and after
every 16 words; white space belongs to the leaf before it, so the leaves side by side are the text, every code point of it.
A section ends at the last paragraph and after each paragraph whose node ends in ``SECTION_BITS`` zero bits (a boundary
that moves with its content, so an edit changes its own section only).  A leaf's node is the hash of its text, a
paragraph's that of its leaves' nodes, a section's that of its paragraphs' nodes, the root that of the sections' nodes
and of nothing else.  Nodes are the first 128 bits of SHA-256, over a letter for the level and then the content.  The
fingerprint is text:

    root ; sections ; paragraphs ; leaves

with commas between the nodes below one node, and ``/`` between those below one
node and those below the next.  So every node can be checked against the nodes below it.
Equal roots mean equal texts; otherwise :func:`edits` goes down the branches that differ.  Likeness is the Dice
coefficient of the two sets of leaves.

Edge cases: null text counts as empty; an empty text has a root and no
branches, and is like another such text by 1 and like others by 0; repeated rows
have equal fingerprints; extra columns are carried along by :func:`fingerprints`,
except ones named like its results.
In :func:`with_next`, a null key comes before all others; rows of one key follow each other in an order of their own,
and a key of many rows is spread over several ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.ranges import LEAST_KEY, boundaries, range_of, tie
from tessera.llm.store import unused

SECTION_BITS = 3
#: A paragraph with its line end; a leaf: up to 15 words that end no sentence and one more, with the white space after them.
PARAGRAPH, LEAF = r"[^\n]*\n|[^\n]+", r"(?:\S*[^\s.!?]\s+){0,15}\S+\s*|\s+"


def node(level: str, content: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(level), content), 256), 1, 32)


def paragraphs(text: Column) -> Column:
    """The text's paragraphs as arrays of leaf nodes."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.transform(lines, lambda line: F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), lambda s: node("l", s)))


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint", leaves: str | None = None) -> DataFrame:
    """``docs`` with the fingerprint of each whole text; with ``leaves``, also the array of its distinct leaf nodes."""
    below, nodes, above = (unused(docs, c) for c in ("_below", "_nodes", "_above"))
    rows = docs.withColumn(below, paragraphs(F.col(f"`{text}`")))
    # Paragraph nodes, with the mark that ends each: a section's or not.
    rows = rows.withColumn(nodes, F.transform(below, lambda p: node("p", F.array_join(p, ","))))
    ends = F.lit([f"{d:x}" for d in range(0, 16, 1 << SECTION_BITS)])
    marked = F.transform(nodes, lambda n: F.concat(n, F.when(F.array_contains(ends, F.substring(n, 32, 1)), F.lit("/")).otherwise(F.lit(","))))
    rows = rows.withColumn(nodes, F.regexp_replace(F.array_join(marked, ""), "[,/]$", ""))
    sections = F.filter(F.split(nodes, "/"), lambda s: s != "")
    rows = rows.withColumn(above, F.array_join(F.transform(sections, lambda s: node("s", s)), ","))
    last = F.array_join(F.transform(below, lambda p: F.array_join(p, ",")), "/")
    made = {fingerprint: F.concat_ws(";", node("r", F.col(above)), above, nodes, last)}
    if leaves:
        made[leaves] = F.array_distinct(F.flatten(below))
    return rows.withColumns(made).drop(below, nodes, above)


def leaf_set(text: Column) -> Column:
    return F.array_distinct(F.flatten(paragraphs(text)))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct leaves; 1 for two empty ones."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def _level(fingerprint: Column, k: int, cut: str) -> Column:
    return F.filter(F.split(F.element_at(F.split(fingerprint, ";"), k), cut), lambda x: x != "")


def edits(a: Column, b: Column) -> Column:
    """Where fingerprint ``a`` differs from ``b``: struct of removed, added, moved, arrays of 0-based paragraph numbers.

    Removed: paragraphs of a that b lacks; added: those of b that a lacks; moved: those of a that b has elsewhere or more or less often.  Only the
    paragraphs below sections that the other text lacks are looked at, but for moves.  All are empty if and only if the roots are equal.
    """
    same = F.element_at(F.split(a, ";"), 1) == F.element_at(F.split(b, ";"), 1)
    none = F.array().cast("array<int>")

    def missing(x: Column, y: Column) -> Column:
        # Sections that the other lacks; of their paragraphs, those that the other's own such sections lack.
        left = F.array_except(_level(x, 2, ","), _level(y, 2, ","))
        right = F.array_except(_level(y, 2, ","), _level(x, 2, ","))
        below = lambda f, some: F.flatten(F.transform(F.filter(_level(f, 3, "/"), lambda s: F.array_contains(some, node("s", s))), lambda s: F.split(s, ",")))
        # A paragraph may also stand in a section that both have.
        return F.array_except(F.array_except(below(x, left), below(y, right)), _level(y, 3, "[,/]"))

    def places(x: Column, gone: Column) -> Column:
        return F.filter(F.transform(_level(x, 3, "[,/]"), lambda n, i: F.when(F.array_contains(gone, n), i)), lambda i: i.isNotNull())

    gone, new = missing(a, b), missing(b, a)
    # What both have, in the order of each; between the first and the last difference it has moved.
    kept = lambda x, out: F.filter(F.transform(_level(x, 3, "[,/]"), lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda s: ~F.array_contains(out, s["n"]))
    ours, theirs = kept(a, gone), F.transform(kept(b, new), lambda s: s["n"])
    apart = F.filter(F.zip_with(ours, theirs, lambda s, n: F.when(~s["n"].eqNullSafe(n), F.coalesce(s["i"], F.size(_level(a, 3, "[,/]")) - 1))), lambda i: i.isNotNull())
    return F.when(same, F.struct(none.alias("removed"), none.alias("added"), none.alias("moved"))).otherwise(
        F.struct(places(a, gone).alias("removed"), places(b, new).alias("added"), F.array_distinct(F.filter(apart, lambda i: i >= 0)).alias("moved"))
    )


def differing(a: Column, b: Column) -> Column:
    """0-based numbers of the paragraphs of fingerprint ``a`` that ``b`` lacks or has elsewhere; see :func:`edits`."""
    found = edits(a, b)
    return F.array_sort(F.array_union(found["removed"], found["moved"]))


def with_next(docs: DataFrame, key: str, text: str, into: str) -> DataFrame:
    """(key, text) and the text of the next row in ascending order; after the last row comes the first.

    Rows are dealt into even key ranges; the first row of each range is also dealt
    to the range before, so each range finds its rows' successors by itself.
    """
    spark = docs.sparkSession
    bounds = boundaries(docs, key, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("long"), F.lit(LEAST_KEY)).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("i"))
    rows = rows.withColumn("u", tie(F.col("t"), F.col("i"))).withColumn("r", range_of(F.col("o"), bounds, F.col("u")))
    place = F.struct("o", "u", "i")
    # One row of numbers for each range.
    firsts = sorted((x["r"], tuple(x["p"])) for x in rows.groupBy("r").agg(F.min(place).alias("p")).collect())
    edges = spark.createDataFrame([(r, *p, firsts[n - 1][0]) for n, (r, p) in enumerate(firsts)], "r int, fo long, fu long, fi long, before int")
    placed = rows.join(F.broadcast(edges), "r")
    is_first = (F.col("o") == F.col("fo")) & (F.col("u") == F.col("fu")) & (F.col("i") == F.col("fi"))
    own, copy = F.struct(F.col("r").alias("g"), F.lit(0).alias("c")), F.struct(F.col("before").alias("g"), F.lit(1).alias("c"))
    dealt = placed.select("k", "o", "u", "i", "t", F.inline(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("g", "c"))
    order = Window.partitionBy("g").orderBy("c", "o", "u", "i")
    found = dealt.withColumn(into, F.lead("t").over(order)).where("c = 0")
    return found.select(F.col("k").alias(key), F.col("t").alias(text), into)
