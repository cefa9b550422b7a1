"""Sharding by size-tiered compaction: small immutable shards, merged runs, versioned manifests.

A store is a folder of Parquet files (shards) and manifests.  :func:`append`
writes arrivals as small shards, without a shuffle: one file a task, whose bytes Spark's read splits bound.  :func:`compact` gathers runs
of at least ``fan_in`` shards of one size tier and merges each run into a file
of at most about the target size; runs of runs are planned on the manifest alone,
so each row is rewritten once however many tiers it climbs.  Both end by
committing the next manifest with a rename that fails if that version exists: a
reader sees the old version or the new one, and of two writers one has to try again.  (HDFS, local and network file systems rename
so; on an object store the manifests need a folder that does.)  A manifest is a list of parts of at most ``PART_SHARDS``
shards; a commit writes new parts only for what it adds or changes.
Shards that no kept version lists, also those of writers that failed, are removed by :func:`vacuum`.

A merge is one task that streams its run's files, so memory follows the row group,
and a lost executor costs the merges it was at.  No step shuffles rows or looks at keys, so
skewed columns do not matter.

Edge cases: an empty table appends no shard; rows are kept as they are, with nulls,
repeats and every column (also ones named like the manifest's).  A store has the columns of all its arrivals: a new one is null in
earlier rows, one that an arrival lacks is null there; a column that comes with another type is an error.  A shard above the
target size is left alone; fewer than ``fan_in`` shards of a tier wait for more.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size a merged file aims at, shards of a tier that make a run, tier 0's size.
TARGET_BYTES, FAN_IN, BASE_BYTES = 48 << 20, 4, 1 << 20
#: Merges of a Spark job, jobs side by side, shards of a manifest part.
MERGES_A_JOB, JOBS, PART_SHARDS = 64, 8, 10_000
#: Seconds after which a file that no manifest lists counts as left by a writer that failed.
GRACE = 24 * 3600
_SHARD = "shard_id long, path string, rows long, bytes long"


@dataclass(frozen=True)
class Shard:
    shard_id: int
    path: str
    rows: int
    bytes: int


class ShardStore:
    """One store; ``root`` is a folder on a file system that all machines share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _head(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json", wholetext=True).first()
        return json.loads(text[0])

    def manifest(self, version: int | None = None) -> tuple[int, T.StructType | None, list[Shard]]:
        """Version, schema and shards; version 0 is the empty store."""
        version = (self.versions() or [0])[-1] if version is None else version
        if version == 0:
            return 0, None, []
        head = self._head(version)
        found = self._part_rows(head["parts"]).collect() if head["parts"] else []
        return version, T.StructType.fromJson(head["schema"]), sorted((Shard(*r) for r in found), key=lambda s: s.shard_id)

    def _part_rows(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(_SHARD).json([f"{self.root}/manifest/{p}" for p in parts])

    def _put(self, name: str, body: str) -> None:
        stream = self._fs.create(self._path(f"{self.root}/manifest/{name}"), False)
        stream.write(bytearray(body.encode()))
        stream.close()

    def _commit(self, base: int, schema: T.StructType, shards: list[Shard], gone: set[int] = frozenset(), parts: list[str] | None = None) -> int:
        """Publish version base + 1 with ``shards`` added to those of version ``base`` and ``gone`` left out, or fail if another writer has."""
        kept, new = [], list(shards)
        for p in (self._head(base)["parts"] if base else []) if parts is None else parts:
            rows = [Shard(*r) for r in self._part_rows([p]).collect()] if gone else []
            if gone & {s.shard_id for s in rows}:
                new += [s for s in rows if s.shard_id not in gone]
            else:
                kept.append(p)
        new.sort(key=lambda s: s.shard_id)
        for at in range(0, len(new), PART_SHARDS):
            kept.append(f"p-{uuid.uuid4().hex}.jsonl")
            self._put(kept[-1], "\n".join(json.dumps(asdict(s)) for s in new[at : at + PART_SHARDS]))
        tmp = f"_{uuid.uuid4().hex}"
        self._put(tmp, json.dumps({"schema": schema.jsonValue(), "parts": kept}))
        source, out = self._path(f"{self.root}/manifest/{tmp}"), self._path(f"{self.root}/manifest/v{base + 1:08d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(source, out, options)
        return base + 1

    def _files(self, folder: str) -> list[tuple[str, int]]:
        found = self._fs.listStatus(self._path(folder))
        return sorted((s.getPath().toString(), s.getLen()) for s in found if s.getPath().getName().startswith("part-"))

    def append(self, df: DataFrame, rows: int | None = None) -> int:
        """Write ``df`` as small shards (of at most ``rows`` rows, if given) and commit; the new version."""
        version = (self.versions() or [0])[-1]
        head = self._head(version) if version else None
        schema = merged(T.StructType.fromJson(head["schema"]) if head else None, df.schema)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows or 0).option("compression", "zstd").parquet(folder)
        counts = self._rows(folder, df.schema)
        last = self._part_rows(head["parts"]).agg(F.max("shard_id")).first()[0] if head and head["parts"] else None
        new = [(p, n) for p, n in self._files(folder) if counts.get(p.rsplit("/", 1)[1])]
        added = [Shard((-1 if last is None else last) + 1 + i, p, counts[p.rsplit("/", 1)[1]], n) for i, (p, n) in enumerate(new)]
        return self._commit(version, schema, added)

    def _rows(self, folder: str, schema: T.StructType) -> dict[str, int]:
        """Rows of each file of a folder: one number a shard, which is what a manifest holds."""
        read = self.spark.read.schema(schema).parquet(folder).select(F.input_file_name().alias("f"))
        return {r["f"].rsplit("/", 1)[1]: r["n"] for r in read.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """Merge runs and commit; the version after it (unchanged if nothing is to merge)."""
        version, schema, shards = self.manifest()
        runs = plan_runs([s.bytes for s in shards], target, fan_in)
        if not runs:
            return version
        next_id = 1 + max(s.shard_id for s in shards)

        def merge(some: list[list[int]]) -> list[tuple[str, int, int]]:
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            parts = [self.spark.read.schema(schema).parquet(*[shards[i].path for i in run]).coalesce(1) for run in some]
            reduce(DataFrame.union, parts).write.option("compression", "zstd").parquet(folder)
            return [(p, sum(shards[i].rows for i in some[int(p.rsplit("/", 1)[1].split("-")[1])]), n) for p, n in self._files(folder)]

        jobs = [runs[at : at + MERGES_A_JOB] for at in range(0, len(runs), MERGES_A_JOB)]
        with ThreadPoolExecutor(JOBS) as pool:
            made = [x for job in pool.map(merge, jobs) for x in job]
        out = [Shard(next_id + i, *x) for i, x in enumerate(made)]
        return self._commit(version, schema, out, {shards[i].shard_id for run in runs for i in run})

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Remove the manifests before the last ``keep``, the shards that only they list, and files older than ``grace`` seconds that none lists."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        used, parts = set(), set()
        for v in kept:
            used |= {s.path for s in self.manifest(v)[2]}
            parts |= set(self._head(v)["parts"])
        for v in old:
            for s in self.manifest(v)[2]:
                if s.path not in used:
                    self._fs.delete(self._path(s.path), False)
        for v in old:
            for p in set(self._head(v)["parts"]) - parts:
                self._fs.delete(self._path(f"{self.root}/manifest/{p}"), False)
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        before = (time.time() - grace) * 1000
        stray = lambda s: s.getModificationTime() < before
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            name = s.getPath().getName()
            if stray(s) and (name.startswith("_") or (name.startswith("p-") and name not in parts)):
                self._fs.delete(s.getPath(), False)
        data = self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            # A folder whose files no version lists belongs to a writer that failed, or is at work: then it is young.
            files = [s for s in self._fs.listStatus(folder.getPath())]
            left = [s for s in files if s.getPath().toString() not in used]
            if len(left) == len(files) and all(map(stray, files)) and stray(folder):
                self._fs.delete(folder.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        _, schema, shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema or T.StructType())
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def shards(self, version: int | None = None) -> DataFrame:
        """One row a shard: its id, path, rows, bytes, and the version."""
        version = (self.versions() or [0])[-1] if version is None else version
        parts = self._head(version)["parts"] if version else []
        rows = self._part_rows(parts) if parts else self.spark.createDataFrame([], _SHARD)
        return rows.select("shard_id", "path", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), F.lit(version).alias("version"))


def merged(schema: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both, by name; ValueError if one has two types."""
    fields = {f.name: T.StructField(f.name, f.dataType) for f in (schema or T.StructType()).fields}
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType(list(fields.values()))


def tier(size: int, base: int = BASE_BYTES, fan_in: int = FAN_IN) -> int:
    """0 up to ``base`` bytes, one more for each factor ``fan_in``."""
    t = 0
    while size > base:
        size, t = size / fan_in, t + 1
    return t


def plan_runs(sizes: list[int], target: int = TARGET_BYTES, fan_in: int = FAN_IN, base: int = BASE_BYTES) -> list[list[int]]:
    """Which shards to merge: lists of indices, none in two lists, from the lowest tier up until no tier has a full run."""
    live = {(i,): n for i, n in enumerate(sizes) if n < target}
    while True:
        tiers: dict[int, list[tuple]] = defaultdict(list)
        for run, n in live.items():
            tiers[tier(n, base, fan_in)].append(run)
        merged = False
        for t in sorted(tiers):
            group = sorted(tiers[t], key=lambda r: (live[r], r))
            if len(group) < fan_in:
                continue
            held: tuple = ()
            size = 0
            for run in group:
                n = live[run]
                if held and (size + n > target * 1.25 or size >= target):
                    held, size = (), 0
                if held:
                    live.pop(held)
                    merged = True
                live.pop(run)
                held, size = held + run, size + n
                live[held] = size
            if merged:
                break
        if not merged:
            return sorted(sorted(run) for run in live if len(run) > 1)
