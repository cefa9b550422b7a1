"""The training-data pipeline: language, quality, near duplicates, decontamination, pieces.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps with the columns it was given, the last one the
encoded documents.  A stage works on all rows of its input and learns from them
and from the reference tables of ``sf_dir`` alone.

Edge cases: null or empty texts have no language and leave in the first stage;
of every near-duplicate class one row stays, that of the least id (rows without an id
come after those with one), so different texts under one id are different documents, and
repeated rows leave all but one; empty inputs give empty outputs.  Extra columns pass through all stages, whatever their
names; the last one leaves out the text and columns that have the names of its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op2_near, op3_language, op5_quality, op8_pieces, op10_decontaminate
from tessera.llm.store import drop_path, every, fresh_path, settle, table, unused

#: Documents of a lower language score are rejected.
LEAST_LANGUAGE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    net = op3_language.learn(docs)
    pred, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    scored = op3_language.identify(docs, net, pred=pred, score=score)
    return scored.where((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE)).drop(pred, score)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier predicts to be of good quality; all, if there are no labels to learn from."""
    model = op5_quality.train(docs, table(spark, sf_dir, "labels"))
    if model.intercept == 0 and not any(t.any() for t in model.tables):
        return docs
    pred, score = unused(docs, "quality_pred"), unused(docs, "quality_score")
    return op5_quality.classify(docs, model, score=score, pred=pred).where(F.col(pred) == 1).drop(pred, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each near-duplicate class."""
    # Rows get numbers that a written table keeps: ids may be null or repeat.
    row = unused(docs, "_row")
    rows = settle(docs.select(*every(docs), F.monotonically_increasing_id().alias(row)), "rows")
    classes = op2_near.near_duplicates(rows, row, "text").select(row, "class_id")
    ids = rows.select(row, F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    kept = ids.join(classes, row).groupBy("class_id").agg(F.min(F.struct("none", "id", row)).alias("best")).select(F.col(f"best.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that leak no benchmark item."""
    return op10_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, checked to decode to its text."""
    import public_tokenizers

    vocabulary = op8_pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    # Written in between: a task then has one Python worker, not one to encode and one to decode.
    coded = settle(op8_pieces.encode(docs, vocabulary), "pieces")
    read = op8_pieces.decode(coded, vocabulary)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(op8_pieces.MARKER), F.lit(" "))
    n = (F.octet_length("pieces") / 4).cast("long")
    made = {"n_pieces": n, "pieces_crc32": F.crc32("pieces"), "round_trip": same, "pieces": F.col("pieces")}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*made, "text", "decoded"}]
    return read.select(*kept, *[c.alias(name) for name, c in made.items()])


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: The models of the first two stages are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
