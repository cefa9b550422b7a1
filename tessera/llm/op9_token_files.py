"""Token ids of whole texts in range-coded files, in ascending key order.

An archive is a folder of two Parquet tables that can be read from its path alone:

    header    one row: format version, SHA-256 of the vocabulary file and its size, the end id, the shared frequency
              table, the numbers of documents and ids, and the number of ids before each shard
    segments  (shard, place, n_docs, n_tokens, data): whole documents, about ``SEGMENT`` ids, in files of ascending order;
              data holds a checksum of the frequency table, the documents' keys and lengths and independent blocks with lanes,
              checkpoints and checksums (see ``tessera.llm.rans``)

Three passes write it: deal the documents into ascending key ranges (shards) and tokenise them (a
table of id arrays), count all ids (one shared frequency table for the corpus),
then code the ids.  Tables are written by
Spark's committer, so a lost executor leaves no half file, and the header last.  :func:`read` gives documents,
:func:`tokens` any stretch of ids: it decodes only the blocks that hold it, the first one from the checkpoint before it.

Texts are tokenised by the tokenizers library.  Where the vocabulary file has the one normaliser and pre-tokeniser known to
end pre-tokens at white space and between letters, digits and symbols, in lower case (:data:`CUT_SETTINGS`), each distinct
piece of that kind is encoded by the library once (new ones many together, with a mark between them) and its
ids are reused by all tasks of a Python worker; for other vocabularies whole texts are encoded.

Edge cases: names of special tokens in a text are ordinary text, or with ``special`` those tokens,
as the library has it by default (a text that has one is then encoded whole); null or empty text has the end id alone; null keys come first;
rows of one key stay next to each other, in an order of their own, and are spread over several shards if they are many; an empty table gives
empty files.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.cache import SpanCache
from tessera.llm.kernels import pieces, slices
from tessera.llm.ranges import LEAST_KEY, boundaries, range_of, tie
from tessera.llm.rans import BLOCK, CHECKPOINT, LANES, Coder, quantise
from tessera.llm.store import drop_path, fresh_path, settled_at, ship

SEGMENT = 1 << 20
#: Pieces a worker remembers before it starts anew.
REMEMBERED = 700_000
#: New pieces that the library encodes as one text, and the character between them.
TOGETHER, MARK = 100, "\x01"
_CACHES: dict[tuple[str, bool], Encoder] = {}
_HEAD = struct.Struct("<4sHHIII")
VERSION = 2
#: Settings of vocabulary files whose texts may be cut into pieces (fixed values of the file format).
CUT_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_BLOCK = struct.Struct("<IIIII")


class Encoder:
    """Ids of texts through the tokenizers library: by cached pieces where the vocabulary allows it, else of whole texts."""

    def __init__(self, path: str, special: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        def ids_of(ordinary: bool):
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = ordinary  # their names in a text are ordinary text
            encode = tokenizer.encode_batch_fast
            return lambda texts: [e.ids for e in encode(texts, add_special_tokens=False)]

        plain, self.encode = ids_of(True), ids_of(not special)
        self.names = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values() if t.special] if special else []

        # One byte that the vocabulary writes as one id, which then stands for no other bytes.
        mark = plain([MARK])[0]

        def learn(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [s.decode() for s in spans]
            if self.cut and len(mark) == 1 and not any(MARK in x for x in texts):
                made = plain([f" {MARK} ".join([*texts[i : i + TOGETHER], ""]) for i in range(0, len(texts), TOGETHER)])
                ids = np.fromiter(chain.from_iterable(made), np.uint32)
                ends = np.flatnonzero(ids == mark[0])
                if len(ends) == len(texts):
                    return ids[ids != mark[0]], np.diff(ends, prepend=-1) - 1
            made = plain(texts)
            return np.array([i for ids in made for i in ids], np.uint32), np.array([len(ids) for ids in made], np.int64)

        self.cache = SpanCache(learn, REMEMBERED)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.cut = all(file.get(k) == v for k, v in CUT_SETTINGS.items()) and file["model"].get("dropout") is None and all(t["special"] for t in file["added_tokens"])

    def __call__(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the number of ids of each text."""
        if self.cut:
            named = np.zeros(len(column), bool)
            for name in self.names:
                named |= pc.match_substring(column, name, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
            if not named.any():
                return self.cache(pieces(column), end)
            ids, total = self.cache(pieces(pc.if_else(pa.array(named), pa.scalar(None, column.type), column)), end)
            made = self.encode(column.filter(pa.array(named)).to_pylist())
            sizes = np.array([len(m) for m in made], np.int64)
            ids = np.insert(ids, np.repeat(np.cumsum(total)[named] - 1, sizes), np.concatenate([np.array(m, np.uint32) for m in made]))
            total[named] += sizes
            return ids, total
        made = [np.array([*ids, end], np.uint32) for ids in self.encode([x or "" for x in column.to_pylist()])]
        return np.concatenate([np.empty(0, np.uint32), *made]), np.array([len(m) for m in made], np.int64)


def cached(path: str, special: bool) -> Encoder:
    if (path, special) not in _CACHES:
        _CACHES[path, special] = Encoder(path, special)
    return _CACHES[path, special]


def tokenise(docs: DataFrame, path: str, key: str, text: str, end: int, special: bool = False) -> DataFrame:
    """Rows of (shard, seq, place, k, n_tokens, ids), ascending in k; place: ids of the shard before; ids as little-endian integers, ending with ``end``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    kind = "<u2" if max(Tokenizer.from_file(path).get_vocab_size() - 1, end) < 1 << 16 else "<u4"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Several ranges a partition: their sizes even out.
    bounds = boundaries(docs, key, 4 * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, seq, before = cached(path, special), -1, 0, 0
        for batch in batches:
            for part in slices(batch, "t"):
                ids, total = encode(part.column("t"), end)
                ends = np.concatenate([[0], np.cumsum(total) * int(kind[2])]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(total), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])
                shards = part.column("shard").to_numpy()
                starts = np.flatnonzero(np.diff(shards, prepend=shards[0] - 1))
                nth = np.arange(len(shards)) - np.repeat(starts, np.diff(np.append(starts, len(shards))))
                if shards[0] == shard:
                    nth[: starts[1] if len(starts) > 1 else None] += seq
                ends_at = np.cumsum(total)
                begin = ends_at - total
                place = begin - np.repeat(begin[starts], np.diff(np.append(starts, len(shards))))
                if shards[0] == shard:
                    place[: starts[1] if len(starts) > 1 else None] += before
                shard, seq, before = shards[-1], nth[-1] + 1, place[-1] + total[-1]
                yield pa.RecordBatch.from_arrays([part.column("shard"), pa.array(nth), pa.array(place), part.column("k"), pa.array(total), packed], ["shard", "seq", "place", "k", "n_tokens", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.monotonically_increasing_id().alias("i"))
    rows = rows.withColumn("u", tie(F.coalesce("t", F.lit("")), F.col("i")))
    rows = rows.withColumn("shard", range_of(F.coalesce("k", F.lit(LEAST_KEY)), bounds, F.col("u")))
    # Neighbouring shards go to one partition, lower ones to lower partitions.
    dealt = rows.repartitionById(n, F.least(F.floor(F.col("shard") * n / (len(bounds) + 1)), F.lit(n - 1)).cast("int")).sortWithinPartitions("shard", "k", "u", "i")
    return dealt.select("k", "t", "shard").mapInArrow(run, "shard int, seq long, place long, k long, n_tokens long, ids binary")


def count_ids(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the whole table; each task sends one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, np.int64)
        for batch in batches:
            col = batch.column(0)
            _, at, data = col.buffers()
            if data is None or not len(col):
                continue
            at = np.frombuffer(at, np.int32)[col.offset : col.offset + len(col) + 1]
            tokens = sum(batch.column(1).to_pylist())
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
            seen += np.bincount(raw.view(f"<u{len(raw) // max(1, tokens)}"), minlength=vocabulary)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["id", "n"])

    got = ids.select("ids", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return counts


def pack_segment(coder: Coder, keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a segment."""
    blocks = coder.encode(ids)
    parts = [_HEAD.pack(b"TRNS", VERSION, LANES, coder.check, len(keys), len(blocks)), keys.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes()]
    for b in blocks:
        body = b["at"].astype("<u4").tobytes() + b["states"].astype("<u8").tobytes() + b["words"].astype("<u4").tobytes()
        parts += [_BLOCK.pack(b["n"], b["steps"], b["crc"], len(b["words"]), zlib.crc32(body)), body]
    return b"".join(parts)


def open_segment(coder: Coder, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Keys, their nulls, lengths and coded blocks of a segment; ValueError if it is damaged or of another frequency table."""
    magic, version, lanes, check, n_docs, n_blocks = _HEAD.unpack_from(data)
    if magic != b"TRNS" or version != VERSION or lanes != LANES:
        raise ValueError("not a token segment")
    if check != coder.check:
        raise ValueError("the segment is of another frequency table")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    blocks = []
    for _ in range(n_blocks):
        n, steps, crc, n_words, check = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        marks = -(-steps // CHECKPOINT)
        size = marks * 4 + marks * LANES * 8 + n_words * 4
        if zlib.crc32(data[at : at + size]) != check:
            raise ValueError("a block's bytes are damaged")
        blocks.append({"n": n, "steps": steps, "crc": crc, "at": np.frombuffer(data, "<u4", marks, at), "states": np.frombuffer(data, "<u8", marks * LANES, at + 4 * marks).reshape(marks, LANES), "words": np.frombuffer(data, "<u4", n_words, at + marks * (4 + 8 * LANES))})
        at += size
    return keys, nulls, lengths, blocks


def write_segments(ids: DataFrame, freq: np.ndarray, root: str) -> None:
    """The ids as coded segments (shard, place, n_docs, n_tokens, data), in files of ascending order."""
    spark = ids.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.array([x[3] or 0 for x in held], np.int64)
            nulls = np.array([x[3] is None for x in held])
            lengths = np.array([x[4] for x in held], np.int64)
            joined = b"".join(x[5] for x in held)
            data = pack_segment(coder, keys, nulls, lengths, np.frombuffer(joined, f"<u{len(joined) // size}").astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((held[0][0], pa.int32()), (held[0][2], pa.int64()), (len(held), pa.int64()), (size, pa.int64()), (data, pa.binary()))], ["shard", "place", "n_docs", "n_tokens", "data"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (size >= SEGMENT or row[0] != held[-1][0] or row[1] != held[-1][1] + 1):
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += row[4]
        if held:
            yield flush()

    # Files are read in row order, so a task's rows are runs of consecutive documents of a shard.  The segments are small: they move
    # once more, into files that follow each other.
    rows = ids.select("shard", "seq", "place", "k", "n_tokens", "ids").mapInArrow(run, "shard int, place long, n_docs long, n_tokens long, data binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 + (ids.agg(F.max("shard")).first()[0] or 0)
    placed = rows.repartitionById(n, F.least(F.floor(F.col("shard") * n / shards), F.lit(n - 1)).cast("int")).sortWithinPartitions("shard", "place")
    placed.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{root}/segments")


SEGMENTS = "shard int, place long, n_docs long, n_tokens long, data binary"
HEADER = "format string, version int, vocabulary_sha256 string, vocabulary_size long, end long, freq binary, n_docs long, n_tokens long, shards array<struct<shard:int,begin:long>>"


def write(docs: DataFrame, vocabulary: str, root: str, key: str = "doc_id", text: str = "text", end: int = 1, special: bool = False) -> str:
    """Tokenise ``docs`` and write them to the folder ``root``, which all machines share; its path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path, ids = settled_at(tokenise(docs, vocabulary, key, text, end, special), "ids")
    size = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end + 1)
    freq = quantise(count_ids(ids, size))
    write_segments(ids, freq, root)
    drop_path(spark, path)
    # One number a shard, as many as key ranges.
    sums = spark.read.schema(SEGMENTS).parquet(f"{root}/segments").groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.sum("n_docs").alias("d")).orderBy("shard").collect()
    shards, total = [], 0
    for r in sums:
        shards.append((r["shard"], total))
        total += r["n"]
    with open(vocabulary, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    header = [("TRNS", VERSION, digest, size, end, bytearray(freq.astype("<u4").tobytes()), sum(r["d"] for r in sums), total, shards)]
    spark.createDataFrame(header, HEADER).coalesce(1).write.mode("overwrite").parquet(f"{root}/header")
    return root


def header(spark: SparkSession, root: str) -> dict:
    """The header of an archive, the frequency table as an array."""
    row = spark.read.schema(HEADER).parquet(f"{root}/header").first().asDict()
    if (row["format"], row["version"]) != ("TRNS", VERSION):
        raise ValueError("not a token archive of this version")
    return row | {"freq": np.frombuffer(row["freq"], "<u4").astype(np.int64)}


def _placed(spark: SparkSession, root: str, head: dict) -> DataFrame:
    """(start, n_tokens, data): the segments with the number of ids before each."""
    ship(spark)
    segments = spark.read.schema(SEGMENTS).parquet(f"{root}/segments")
    begins = spark.createDataFrame([tuple(s) for s in head["shards"]], "shard int, begin long")
    return segments.join(F.broadcast(begins), "shard").select((F.col("begin") + F.col("place")).alias("start"), "n_tokens", "data")


def read(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) as the files at ``root`` have them."""
    head = header(spark, root)
    freq = head["freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, nulls, lengths, blocks = open_segment(coder, data.as_buffer().to_pybytes())
                ids = np.concatenate([np.empty(0, np.uint32), *coder.decode(blocks)])
                ends = np.cumsum(lengths.astype(np.int64))
                raw, begins_at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), ends - lengths
                parts = [raw[4 * a : 4 * b] for a, b in zip(begins_at.tolist(), ends.tolist())]
                cols = [pa.array(keys, pa.int64(), mask=nulls), pa.array(start + begins_at), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([bytes(p) for p in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return _placed(spark, root, head).select("start", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def tokens(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """(start, ids): the ids from place ``first`` up to, not with, ``last`` of the whole archive, a row a block, as little-endian 32-bit integers."""
    head = header(spark, root)
    freq, unit = head["freq"], CHECKPOINT * LANES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, block in enumerate(open_segment(coder, data.as_buffer().to_pybytes())[3]):
                    begin = start + k * BLOCK
                    a, b = max(first - begin, 0), min(last - begin, block["n"])
                    if a < b:
                        mark = a // unit
                        ids = coder.decode([block], mark, b)[0][a - mark * unit : b - mark * unit]
                        yield pa.RecordBatch.from_arrays([pa.array([begin + a]), pa.array([np.ascontiguousarray(ids, "<u4").tobytes()], pa.binary())], ["start", "ids"])

    some = _placed(spark, root, head).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    return some.select("start", "data").mapInArrow(run, "start long, ids binary")


def temporary(docs: DataFrame) -> str:
    """A folder for an archive that goes with the session."""
    return fresh_path(docs.sparkSession, "tokens")
