"""Portable archives: one .tar.xz of LEB128 streams and text tables a chunk.

The fixed values of the format are its file names (``l<len>_0.bin`` for numbers by
digits, ``_<pattern id>_<column lengths>.bin`` and ``_<pattern id>_delta_<lengths>.bin`` for matrices,
``templateid.bin``, ``tokenid.bin``, ``token.txt``, ``template.txt``) and its marks in
templates: ``<a>`` to ``<o>`` for numbers of 1 to 15 digits, ``<*>`` for
dictionary strings, ``|letters|`` for a pattern's id.

A chunk is bounded by the run's settings, and each is coded by one task.  The
format has no escape for marks in the text; lines whose chunk has such text are
kept in the native archive only, and the writer says so with an error.
"""

from __future__ import annotations

import io
import re
import tarfile
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SAMPLE_ROWS, Settings

from tessera.functions import tokens as t
from tessera.operators import encode, mine, parse, profile
from tessera.plans import workspace


# LEB128 -----------------------------------------------------------------------------------------------------------


def unsigned_leb(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def signed_leb(v: int) -> bytes:
    out = bytearray()
    while not -64 <= v < 64:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v & 127)
    return bytes(out)


class Reader:
    """Reads LEB128 values one after another."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    @property
    def done(self) -> bool:
        return self.at >= len(self.data)

    def _raw(self) -> tuple[int, int]:
        value = bits = 0
        while True:
            if self.at >= len(self.data):
                raise ValueError("stream ends within a value")
            b = self.data[self.at]
            self.at += 1
            value |= (b & 127) << bits
            bits += 7
            if b < 128:
                return value, bits

    def unsigned(self) -> int:
        return self._raw()[0]

    def signed(self) -> int:
        value, bits = self._raw()
        return value - (1 << bits) if value >> (bits - 1) else value


def steps(values: list[int]) -> list[int]:
    return [v - p for v, p in zip(values, [0, *values])]


def prefers_steps(values: list[int]) -> bool:
    """Whether the first values are smaller as differences."""
    some = values[:SAMPLE_ROWS]
    return sum(map(abs, steps(some))) < sum(map(abs, some))


def column_bytes(values: list[int], raw_signed: bool) -> bytes:
    """A flag (1: differences) and the values; raw values are signed in number streams, unsigned in matrices."""
    if prefers_steps(values):
        return unsigned_leb(1) + b"".join(map(signed_leb, steps(values)))
    return unsigned_leb(0) + b"".join(map(signed_leb if raw_signed else unsigned_leb, values))


def read_column(r: Reader, n: int | None, raw_signed: bool) -> list[int]:
    """``n`` values, or all up to the end of the stream."""
    as_steps = r.unsigned() == 1
    out: list[int] = []
    total = 0
    while not r.done if n is None else len(out) < n:
        if as_steps:
            total += r.signed()
            out.append(total)
        else:
            out.append(r.signed() if raw_signed else r.unsigned())
    return out


def matrix_bytes(columns: list[list[int]]) -> bytes:
    return unsigned_leb(len(columns)) + unsigned_leb(len(columns[0])) + b"".join(column_bytes(c, False) for c in columns)


def read_matrix(data: bytes) -> list[list[int]]:
    r = Reader(data)
    n_columns, n_rows = r.unsigned(), r.unsigned()
    return [read_column(r, n_rows, False) for _ in range(n_columns)]


def joined_bytes(values: list[int]) -> bytes:
    """A matrix as one number a row: the first, then differences with their sign in the lowest bit."""
    out = [unsigned_leb(1), unsigned_leb(len(values)), unsigned_leb(values[0])]
    out += [unsigned_leb(abs(d) << 1 | (d < 0)) for d in steps(values)[1:]]
    return b"".join(out)


def read_joined(data: bytes) -> list[int]:
    r = Reader(data)
    r.unsigned()
    n = r.unsigned()
    out = [r.unsigned()]
    while len(out) < n:
        v = r.unsigned()
        out.append(out[-1] + (-(v >> 1) if v & 1 else v >> 1))
    return out


def letters(n: int) -> str:
    """Bijective base 26: 0 is a, 26 aa."""
    out = ""
    n += 1
    while n:
        n, d = divmod(n - 1, 26)
        out = chr(97 + d) + out
    return out


def id_of(word: str) -> int:
    n = 0
    for c in word:
        n = n * 26 + ord(c) - 96
    return n - 1


# Writing ----------------------------------------------------------------------------------------------------------

_MARK = re.compile(r"\|([a-z]+)\||<([a-o])>|(<\*>)")


def pack_chunk(templates: list[str], ids: list[int], nums: dict[int, list[int]], tokens: list[str], stream: list[int], matrices: dict[str, bytes]) -> bytes:
    """The chunk's files as a .tar.xz."""
    files = {f"l{n}_0.bin": column_bytes(v, True) for n, v in nums.items() if v} | matrices
    files["templateid.bin"] = b"".join(map(unsigned_leb, ids))
    files["tokenid.bin"] = b"".join(map(unsigned_leb, stream))
    files["token.txt"] = "".join(f"{x}\n" for x in tokens).encode()
    files["template.txt"] = "".join(f"{x}\n" for x in templates).encode()
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:xz") as tar:
        for name in sorted(files):
            info = tarfile.TarInfo(name)
            info.size = len(files[name])
            tar.addfile(info, io.BytesIO(files[name]))
    return out.getvalue()


def unpack_files(data: bytes) -> dict[str, bytes]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:xz") as tar:
        return {m.name.removeprefix("./"): tar.extractfile(m).read() for m in tar.getmembers() if m.isfile()}


def write_archives(lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(chunk_id, content): the .tar.xz of each chunk.  Empty lines are not kept, as the format has none."""
    workspace.ship(lines.sparkSession)
    rows = lines.where(F.coalesce(F.col("line"), F.lit("")) != "")
    # Tables that several branches read are written once.
    toks = workspace.settle(parse.tokenised(rows), "tokens")
    variables = toks.select("chunk_id", "row_no", F.inline(t.variables(F.col("toks"))))
    distinct = workspace.settle(parse.distinct_composites(variables), "distinct")
    rules = workspace.settle(mine.mined(distinct, settings), "rules")
    columns = mine.pattern_columns(rules)
    ids = workspace.settle(encode.dictionary(variables, rules, columns, profile.slot_stats(profile.slot_values(distinct))), "dictionary")
    pats = ids.select("chunk_id", "id", F.col("token").alias("pattern"))
    named = rules.select("chunk_id", "tok", "pattern", "vals").join(pats, ["chunk_id", "pattern"]).select("chunk_id", "tok", F.col("id").alias("pid"), "vals")
    comp = variables.where("cls = 'comp'").join(named, ["chunk_id", "tok"]).select("chunk_id", "row_no", "pos", "cls", "tok", F.col("pid").alias("id"), "vals")
    strs = variables.where("cls = 'str'").join(ids.withColumnRenamed("token", "tok"), ["chunk_id", "tok"]).select("chunk_id", "row_no", "pos", "cls", "tok", "id", F.array().cast("array<string>").alias("vals"))
    nums = variables.where("cls = 'num'").select("chunk_id", "row_no", "pos", "cls", "tok", F.lit(None).cast("long").alias("id"), F.array().cast("array<string>").alias("vals"))
    entries = comp.unionByName(strs).unionByName(nums).groupBy("chunk_id", "row_no").agg(F.sort_array(F.collect_list(F.struct("pos", "cls", "tok", "id", "vals"))).alias("vars"))
    body = toks.select("chunk_id", "row_no", t.shape(F.col("toks")).alias("shape")).join(entries, ["chunk_id", "row_no"], "left")
    kinds = columns.select("chunk_id", "pattern", "col", "fixed_len", encode.numeric_column().alias("numeric")).join(pats, ["chunk_id", "pattern"])

    # Lines, dictionary and columns of a chunk meet in one task: a chunk is a bounded number of lines.
    none = F.lit(None)
    first = body.select("chunk_id", F.lit("line").alias("kind"), "row_no", F.to_json("shape").alias("a"), F.to_json("vars").alias("b"), none.cast("int").alias("n"), none.cast("boolean").alias("flag"))
    second = ids.select("chunk_id", F.lit("dict").alias("kind"), F.col("id").alias("row_no"), F.col("token").alias("a"), none.cast("string").alias("b"), none.cast("int").alias("n"), none.cast("boolean").alias("flag"))
    third = kinds.select("chunk_id", F.lit("col").alias("kind"), F.col("id").alias("row_no"), F.col("col").cast("string").alias("a"), none.cast("string").alias("b"), F.col("fixed_len").alias("n"), F.col("numeric").alias("flag"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        chunk = int(pdf["chunk_id"].iloc[0])
        part = {k: g.sort_values("row_no") for k, g in pdf.groupby("kind")}
        words = part["dict"]["a"].tolist() if "dict" in part else []
        place = {w: i for i, w in enumerate(words)}
        kinds: dict[int, dict[int, tuple[int, bool]]] = defaultdict(dict)
        for pid, col, n, flag in zip(*(part["col"][c] for c in ("row_no", "a", "n", "flag"))) if "col" in part else ():
            kinds[int(pid)][int(col)] = (int(n), bool(flag))
        templates: dict[str, int] = {}
        order, stream = [], []
        nums: dict[int, list[int]] = defaultdict(list)
        found: dict[int, list[list[str]]] = defaultdict(list)
        for shape, vars_ in zip(part["line"]["a"], part["line"]["b"]) if "line" in part else ():
            held = {v["pos"]: v for v in json.loads(vars_ or "[]")}
            text = ""
            for i, s in enumerate(json.loads(shape)):
                if s["cls"] == "lit":
                    text += s["text"]
                elif s["cls"] == "num":
                    tok = held[i]["tok"]
                    nums[len(tok)].append(int(tok))
                    text += f"<{chr(96 + len(tok))}>"
                elif s["cls"] == "str":
                    stream.append(held[i]["id"])
                    text += "<*>"
                else:
                    text += f"|{letters(held[i]['id'])}|"
                    if held[i].get("vals"):
                        found[held[i]["id"]].append(held[i]["vals"])
            literal = "".join(s["text"] for s in json.loads(shape) if s["cls"] == "lit")
            if "|" in literal or _MARK.search(literal):
                raise ValueError(f"chunk {chunk} has marks of the portable format in its text; use the native archive")
            order.append(templates.setdefault(text, len(templates)))
        matrices = {}
        for pid, rows in found.items():
            info = [kinds[pid][c] for c in range(len(rows[0]))]
            lengths = "_".join(str(n) for n, _ in info)
            whole = ["".join(r) for r in rows]
            if len(info) >= 2 and len(rows) >= 2 and all(n > 0 and num for n, num in info) and len(whole[0]) <= encode.LONG_DIGITS:
                values = list(map(int, whole))
                some = values[:SAMPLE_ROWS]
                if max(some) > 0 and max(map(abs, steps(some)[1:])) * 10 < max(some):
                    matrices[f"_{pid}_delta_{lengths}.bin"] = joined_bytes(values)
                    continue
            code = lambda v, num: 2 * int(v) if num or (v.isascii() and v.isdigit() and len(v) <= 15 and (len(v) == 1 or v[0] != "0")) else 2 * place[v] + 1
            # A column that holds words has values of their own width.
            names = "_".join(str(n if num else -1) for n, num in info)
            matrices[f"_{pid}_{names}.bin"] = matrix_bytes([[code(r[c], num) for r in rows] for c, (_, num) in enumerate(info)])
        return pd.DataFrame({"chunk_id": [chunk], "content": [pack_chunk(list(templates), order, nums, words, stream, matrices)]})

    return first.unionByName(second).unionByName(third).groupBy("chunk_id").applyInPandas(run, "chunk_id int, content binary")


# Reading ----------------------------------------------------------------------------------------------------------


def _numbers_of(files: dict[str, bytes]) -> dict[int, list[int]]:
    return {int(m[1]): read_column(Reader(data), None, True) for name, data in files.items() if (m := re.fullmatch(r"l(\d+)_\d+\.bin", name))}


def _all(data: bytes) -> list[int]:
    r = Reader(data)
    out = []
    while not r.done:
        out.append(r.unsigned())
    return out


def restore_chunk(content: bytes) -> list[str]:
    """The lines of a chunk.  Streams that end early show as <missing:k>, <INVALID_ID:k> and the like."""
    files = unpack_files(content)
    words = files["token.txt"].decode().split("\n")[:-1]
    templates = files["template.txt"].decode().split("\n")[:-1]
    streams = {n: iter(v) for n, v in _numbers_of(files).items()}
    strings = iter(_all(files["tokenid.bin"]))
    rows: dict[int, Iterator[list[str]]] = {}
    for name, data in files.items():
        if not (m := re.fullmatch(r"_(\d+)_(delta_)?(-?\d+(?:_-?\d+)*)\.bin", name)):
            continue
        widths = [int(x) for x in m[3].split("_")]
        if m[2]:
            ends = [sum(widths[: i + 1]) for i in range(len(widths))]
            rows[int(m[1])] = iter([[f"{v:0{ends[-1]}d}"[e - w : e] for w, e in zip(widths, ends)] for v in read_joined(data)])
        else:
            show = lambda v, w: (words[v >> 1] if v >> 1 < len(words) else f"<unknown_token:{v >> 1}>") if v & 1 else f"{v >> 1:0{max(w, 1)}d}"
            rows[int(m[1])] = iter([[show(v, w) for v, w in zip(r, widths)] for r in zip(*read_matrix(data))])

    def value(m: re.Match) -> str:
        if m[2]:
            n = ord(m[2]) - 96
            v = next(streams.get(n, iter(())), None)
            return f"<missing:{n}>" if v is None else f"{v:0{n}d}"
        k = id_of(m[1]) if m[1] else next(strings, None)
        if k is None or k >= len(words):
            return f"<unknown_token:{k}>"
        if not m[1] or "<>" not in words[k]:
            return words[k]
        vals = next(rows.get(k, iter(())), None)
        if vals is None:
            return f"<no_more_instances:{k}>"
        pieces = words[k].split("<>")
        return "".join(p + v for p, v in zip(pieces, [*vals, ""]))

    return [_MARK.sub(value, templates[i] if i < len(templates) else f"<INVALID_ID:{i}>") for i in _all(files["templateid.bin"])]


def read_archives(archives: DataFrame) -> DataFrame:
    """(chunk_id, line_no, line) of all archives."""
    workspace.ship(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, content in zip(pdf["chunk_id"], pdf["content"]):
                lines = restore_chunk(content)
                yield pd.DataFrame({"chunk_id": chunk, "line_no": range(len(lines)), "line": lines}).astype({"chunk_id": "int32", "line_no": "int64"})

    return archives.select("chunk_id", "content").mapInPandas(run, "chunk_id int, line_no long, line string")


def read_numbers(archives: DataFrame) -> DataFrame:
    """(chunk_id, len, seq, value) of the number streams."""
    workspace.ship(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, content in zip(pdf["chunk_id"], pdf["content"]):
                for n, values in _numbers_of(unpack_files(content)).items():
                    yield pd.DataFrame({"chunk_id": chunk, "len": n, "seq": range(len(values)), "value": values}).astype({"chunk_id": "int32", "len": "int32", "seq": "int64", "value": "int64"})

    return archives.select("chunk_id", "content").mapInPandas(run, "chunk_id int, len int, seq long, value long")


def export(archives: DataFrame, folder: str) -> None:
    """Write each chunk's archive to ``folder`` as <chunk>.tar.xz (a folder that the driver can reach), one at a time."""
    from pathlib import Path

    Path(folder).mkdir(parents=True, exist_ok=True)
    for row in archives.toLocalIterator():
        (Path(folder) / f"{row['chunk_id']}.tar.xz").write_bytes(row["content"])


def load(spark, folder: str) -> DataFrame:
    """(chunk_id, content) of the .tar.xz files in ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.xz").load(folder)
    return files.select(F.regexp_extract("path", r"(\d+)\.tar\.xz$", 1).cast("int").alias("chunk_id"), "content")


