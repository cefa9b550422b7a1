"""Dictionary-compressed WARC archives (.warc.zst), written and read back.

Each archive is one value of a Parquet table, so the writing and the commit are
Spark's own and work on any file system: a leading skippable frame that holds a
Zstandard dictionary built from the archive's records, then one frame for each
record.  ``cat``-ing the value to a file gives a .warc.zst as readers know it.

Of records with one payload the one with the largest key is the ``response``;
the others are ``revisit`` records that carry its HTTP headers but no payload.

Edge cases: null html is an empty payload; null url leaves out the target URI;
rows with a null key become revisits of the largest non-null key with their
payload, or responses where there is none; repeated rows with the winning key are
all responses.  An empty table gives no archive.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import settle, ship

#: Frame type that .warc.zst readers look for (fixed value of the format).
DICTIONARY_FRAME = 0x184D2A5D
#: Uncompressed record bytes an archive, dictionary bytes, record bytes the dictionary is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 32 << 10, 2 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, row: int = 0, refers_row: int = 0, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit if ``refers_to`` is given.  ``row`` tells records of one key apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}:{row}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}:{refers_row}>")
    body = http if refers_to is not None else http + payload
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary of a bounded, evenly spread sample; of plain content if there is too little to train on."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[: 64 << 10] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


def pack(records: list[bytes]) -> bytes:
    """Archive bytes: the dictionary's skippable frame and a frame for each record."""
    raw = build_dictionary(records)
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(coder.compress, records)])


def unpack(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME:
        raise ValueError("archive has no leading dictionary frame")
    words = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    source = zstandard.ZstdDecompressor(dict_data=words).stream_reader(memoryview(archive)[8 + size :], read_across_frames=True)
    rest, ended = b"", False
    while True:
        while (cut := rest.find(b"\r\n\r\n")) < 0 and not ended:
            more = source.read(1 << 18)
            ended = not more
            rest += more
        if cut < 0:
            if rest:
                raise ValueError("archive ends within a record")
            return
        lines = rest[:cut].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        need = cut + 8 + int(headers["Content-Length"])
        parts, have = [rest], len(rest)
        while have < need:
            more = source.read(max(1 << 18, need - have))
            if not more:
                raise ValueError("archive ends within a record")
            parts.append(more)
            have += len(more)
        rest = b"".join(parts) if len(parts) > 1 else rest
        yield headers, rest[cut + 4 : need - 4]
        rest = rest[need:]


def _key(uri: str | None) -> int | None:
    digits = uri.removeprefix("<urn:page:").partition(":")[0] if uri else ""
    return int(digits) if digits else None


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages; the archives as a table (n_records, content)."""
    ship(pages.sparkSession)
    # Row numbers make record ids unique; they are settled first, so every branch and every retry has the same.
    ids = settle(pages.select(F.monotonically_increasing_id().alias("i"), F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h")).withColumn("d", F.sha1("h")), "pages")
    # Copies are found on 20-byte digests; the html itself moves once, with skewed digests split by the adaptive join.
    first = ids.groupBy("d").agg(F.max(F.struct("k", "i")).alias("r"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("d", F.col("r.k").alias("rk"), F.col("r.i").alias("ri"))
    own = F.col("rk").isNull() | F.coalesce(F.col("k") == F.col("rk"), F.lit(False))
    linked = ids.join(first, "d", "left").select("i", "k", "u", "h", F.when(~own, F.col("rk")).alias("r"), "ri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"n_records": pa.array([len(held)], pa.int64()), "content": pa.array([pack(held)], pa.binary())})

        for batch in batches:
            for i, k, u, h, r, ri in zip(*(c if n == "h" else c.to_pylist() for n, c in zip(batch.schema.names, batch.columns))):
                held.append(record(k, u, h.as_buffer().to_pybytes(), r, i, ri))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return settle(linked.mapInArrow(run, "n_records long, content binary"), "warc", "uncompressed")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record: key, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in unpack(content.as_buffer().to_pybytes()):
                    cut = block.index(b"\r\n\r\n") + 4
                    length = int(block[:cut].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = block[cut:] if head["WARC-Type"] == "response" else None
                    if payload is not None and (len(payload) != length or base32_sha1(payload) != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    rows.append((_key(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), length, digest, head["WARC-Type"], _key(head.get("WARC-Refers-To")), payload))
                    size += len(block)
                    if size >= 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return archives.select("content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
