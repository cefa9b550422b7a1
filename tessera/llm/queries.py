"""Driver queries of the corpus-preparation operators: thin views over ``tessera.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.store import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tessera.llm import op1_html as op

    out = op.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    from tessera.llm import op2_near as op

    return op.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; trained without the rows whose crc32(doc_id) mod 3 is 1."""
    from tessera.llm import op3_language as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    net = op.learn(docs.where(~held))
    out = op.identify(docs, net, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the shard that holds it after two arrivals and a compaction."""
    from tessera.llm import op4_compaction as op
    from tessera.llm.store import fresh_path

    docs = table(spark, sf_dir, "documents")
    store = op.ShardStore(spark, fresh_path(spark, "shards"))
    late = F.pmod(F.xxhash64("source"), F.lit(4)) == 0
    for arrival in (~late, late):
        store.append(docs.where(arrival))
    store.compact()
    store.vacuum()
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = store.read().select("doc_id", F.col("n_chars"), name(F.input_file_name()).alias("file"))
    shards = store.shards().withColumn("file", name(F.col("path")))
    return rows.join(shards, "file").select("doc_id", "n_chars", "shard_id", "shard_rows", "shard_bytes", "version")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; trained without the rows whose crc32(doc_id) mod 4 is 2."""
    from tessera.llm import op5_quality as op

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = op.train(docs, table(spark, sf_dir, "labels"), ~held)
    out = op.classify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and its edited text."""
    from tessera.llm import op6_merkle as op

    rows = op.with_next(table(spark, sf_dir, "documents"), "doc_id", "text", "next")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next", F.lit(1), half))
    rows = rows.select("doc_id", "text", edited.alias("edited"), n.cast("long").alias("n_chars"), op.leaf_set(F.col("next")).alias("next_leaves"))
    rows = op.fingerprints(rows, "text", "fingerprint", "leaves")
    rows = op.fingerprints(rows, "edited", "edited_fingerprint", "edited_leaves")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        op.likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        op.likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back from them."""
    from tessera.llm import op7_warc as op

    read = op.read_archives(op.write_archives(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to it."""
    import public_tokenizers

    from tessera.llm import op8_pieces as op

    vocabulary = op.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = op.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id", "text"])
    read = op.decode(coded, vocabulary)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(op.MARKER), F.lit(" "))
    n = (F.octet_length("pieces") / 4).cast("long")
    return read.select("doc_id", n.alias("n_pieces"), F.crc32("pieces").alias("pieces_crc32"), F.char_length("decoded").cast("long").alias("n_chars_decoded"), same.alias("round_trip"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as range-coded segments and read back."""
    import public_tokenizers

    from tessera.llm import op9_token_files as op

    docs = table(spark, sf_dir, "documents")
    return op.read(spark, op.write(docs, public_tokenizers.path("word_bpe_49k.json"), op.temporary(docs), special=True))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    from tessera.llm import op10_decontaminate as op

    return op.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        "op1_html": op1_html,
        "op2_near": op2_near,
        "op3_language": op3_language,
        "op4_compaction": op4_compaction,
        "op5_quality": op5_quality,
        "op6_merkle": op6_merkle,
        "op7_warc": op7_warc,
        "op8_pieces": op8_pieces,
        "op9_token_files": op9_token_files,
        "op10_decontaminate": op10_decontaminate,
    }


#: Every pair of different texts that share a shingle, compared exactly; classes by walking the links.  Texts have numbers of their own: an id may stand on several.
NEAR = r"""WITH RECURSIVE
T AS (SELECT text, rep, row_number() OVER (ORDER BY text) AS i FROM (SELECT coalesce(text, '') AS text, min(doc_id) AS rep FROM documents GROUP BY 1)),
W AS (SELECT i, regexp_extract_all(lower(text), '[^\x00-\x20]+') AS w FROM T),
S AS (SELECT DISTINCT i, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM W),
N AS (SELECT i, count(*) AS n FROM S GROUP BY 1),
P AS (SELECT a.i AS x, b.i AS y, count(*) AS m FROM S a JOIN S b ON a.g = b.g AND a.i <> b.i GROUP BY 1, 2),
L AS (SELECT x, y FROM P JOIN N a ON a.i = x JOIN N b ON b.i = y WHERE 5 * m >= 4 * (a.n + b.n - m)),
R AS (SELECT i, i AS seen FROM T UNION SELECT R.i, L.y FROM R JOIN L ON L.x = R.seen),
C AS (SELECT R.i, min(rep) AS class_id FROM R JOIN T ON T.i = R.seen GROUP BY 1),
K AS (SELECT x AS i, count(*) AS n_links FROM L GROUP BY 1)
SELECT doc_id, T.rep AS text_class, class_id, coalesce(n_links, 0) AS n_links
FROM documents JOIN T ON T.text = coalesce(documents.text, '') JOIN C ON C.i = T.i LEFT JOIN K ON K.i = T.i"""

#: Base 32 takes 5 bits a letter: 4 letters from each 5 hexadecimal digits.
WARC = """WITH D AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
M AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM D)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM M"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are held against brute force in the tests."""
    return {"op2_near": NEAR, "op7_warc": WARC}
