"""N-gram Jaccard join with Bayesian candidate pruning.

Documents whose sets of five-word shingles (lower case, white-space words; a text
of fewer words has one shingle of them all) have a Jaccard similarity of at least
0.8 are linked.

1. Equal texts form a class, found on their digests, which gets a number of its own; one
   sketch a class goes on: its MinHash values.  ``ROWS`` of them, side by side, are a band key, ``BANDS`` in all.
2. Classes that share a band key are candidates.  A bucket of more than ``BLOCK``
   members is dealt into blocks, and each pair of blocks is a unit of its own.  A
   pair is taken up only in the first band that it shares, so once.  Within a unit
   MinHash values are compared ``STEP`` at a time, and a pair is dropped as soon as the
   posterior probability that it reaches the threshold (uniform prior, binomial
   matches) is below ``TOLERANCE``.
3. Every pair that is left is verified on the exact shingle sets, in the unit, once the texts
   have joined it; of the texts only those go there that a bitmap of the candidates lets through.
   Units are dealt by ranges, so that tasks get equal rows.  A unit returns the number of links of each member and a
   spanning forest of the links, never the links themselves, so its result follows its
   members however many copies there are.
4. Forest edges become classes by label propagation with pointer jumping over tables.

A pair at exactly 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8; that
and TOLERANCE are the only losses.

Edge cases: null text counts as empty; texts without words are linked to equal texts
alone; every row is judged by its own text, also where several rows have one key; rows with a null key take part like
others, and a class has a null name if no row of it has a key; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import mix, shingles, slices, words
from tessera.llm.store import drop_path, settle, settled_at, ship

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 32, 4, 16, 1e-6
HASHES = BANDS * ROWS
BLOCK = 256
#: Pairs compared at once, rows of units held at once.
PAIRS, HELD = 1 << 15, 1024
#: Bits of the bitmap of candidates: 16 for each, up to this many (16 MB); beyond, more texts pass it.
MOST_BITS, BITMAP = 1 << 27, 1 << 15

_SEED = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FLIP, _MULT = (_SEED[:HASHES] >> np.uint64(32)).astype(np.uint32), (_SEED[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = STEP, 2 STEP, ... values compared: the fewest matches at which a pair stays."""
    p = (np.arange(200_000) + 0.5) / 200_000
    need = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[p >= threshold].sum() / w.sum() >= tolerance:
                need.append(m)
                break
    return np.array(need)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The keys of the bands of each row of MinHash values: equal in a band if and only if its values are."""
    bands = np.ascontiguousarray(sig).view(np.uint64)
    return mix(bands ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def sketch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct shingles, the low halves of its MinHash values."""
    h, doc = shingles(words(column), SHINGLE)
    n = len(column)
    low = np.full((HASHES, n), 0xFFFFFFFF, np.uint32)
    distinct = np.zeros(n, np.int64)
    if len(h):
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        some = doc[begin]
        x = (h >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            low[k, some] = np.minimum.reduceat((x ^ _FLIP[k]) * _MULT[k], begin)
        order = np.argsort(h ^ mix(doc.astype(np.uint64) + np.uint64(1)), kind="stable")
        pairs = (h ^ mix(doc.astype(np.uint64) + np.uint64(1)))[order]
        distinct = np.bincount(doc[order[np.flatnonzero(np.diff(pairs, prepend=pairs[0] ^ np.uint64(1)))]], minlength=n)
    return distinct, np.ascontiguousarray(((low ^ (low >> np.uint32(16))) & np.uint32(0xFFFF)).astype(np.uint16).T)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a class of equal texts: digest, id (a number), rep (its least key), n shingles, sig."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("digest", F.md5("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", 1 << 19):
                n, sig = sketch(part.column("t"))
                packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * 2 * HASHES).astype(np.int32)), pa.py_buffer(sig)])
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("digest"), pa.array(n.astype(np.int32)), packed], ["k", "digest", "n", "sig"])

    made = rows.select("k", "digest", "t").mapInArrow(run, "k long, digest string, n int, sig binary")
    # Rows of equal texts have equal sketches.
    one = made.groupBy("digest").agg(F.min("k").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    return settle(one.select("digest", F.monotonically_increasing_id().alias("id"), "rep", "n", "sig"), "sketches")


def _runs(batches: Iterator[pa.RecordBatch], unit: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of whole units (rows of equal ``unit`` columns stand together), about HELD rows each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < HELD:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(whole.num_rows, bool)
        for c in unit:
            v = whole.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            yield whole.slice(0, cut[-1])
            rest = whole.slice(cut[-1]).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def candidates(reps: DataFrame) -> DataFrame:
    """Pairs left by the pruning: (unit, id, partners), a row for each member of a unit that is in some pair."""
    keyed = reps.where("n > 0").select("id", "sig")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), pa.array(keys)], ["id", "band", "key"])

    places = keyed.mapInArrow(split, "id long, band int, key long")
    counts = places.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = places.join(counts, "key").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id", "band"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.select("key", "band", "id", "own", other).select("key", "band", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    rows = dealt.join(reps.select("id", "n", "sig"), "id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
    need = fewest_matches()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("key", "lo", "hi")):
            key, lo, hi, own, rep, n, band = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "id", "n", "band"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            bands = sig.view(np.uint64)
            begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            end_of = np.repeat(np.append(begin[1:], len(key)), np.diff(np.append(begin, len(key))))
            left = end_of - np.arange(len(key)) - 1
            sums = np.concatenate([[0], np.cumsum(left)])
            at, got = 0, []
            while at < len(key):
                stop = max(at + 1, int(np.searchsorted(sums, sums[at] + PAIRS, side="right")) - 1)
                i = np.repeat(np.arange(at, stop), left[at:stop])
                j = i + 1 + np.arange(len(i)) - np.repeat(sums[at:stop] - sums[at], left[at:stop])
                ok = (np.minimum(n[i], n[j]) * 5 >= np.maximum(n[i], n[j]) * 4) & (rep[i] != rep[j])
                ok &= (lo[i] == hi[i]) | (own[i] != own[j])
                i, j = i[ok], j[ok]
                first = (bands[i] == bands[j]).argmax(axis=1) == band[i]
                i, j = i[first], j[first]
                same = np.zeros(len(i), np.int64)
                for s, m in enumerate(need):
                    same += (sig[i, s * STEP : (s + 1) * STEP] == sig[j, s * STEP : (s + 1) * STEP]).sum(axis=1)
                    stay = same >= m
                    i, j, same = i[stay], j[stay], same[stay]
                got.append((i, j))
                at = stop
            i, j = (np.concatenate(c) for c in zip(*got))
            if not len(i):
                continue
            # A row for each member of a pair, with its partners that come after it.
            who = np.unique(np.concatenate([i, j]))
            order = np.argsort(i, kind="stable")
            sizes = np.zeros(len(key), np.int64)
            np.add.at(sizes, i, 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[who])]).astype(np.int32)), pa.array(rep[j[order]]))
            code = mix(mix(key.view(np.uint64) + lo.astype(np.uint64)) + hi.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code[who]), pa.array(rep[who]), lists], ["unit", "id", "partners"])

    return settle(rows.mapInArrow(prune, "unit long, id long, partners array<long>"), "candidates")


def exact_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of sets (sorted distinct hashes) have a Jaccard similarity of at least 4/5."""
    n = np.array([len(s) for s in sets])
    if len(i) > 8 * len(sets):
        # Many pairs of few sets: count common shingles as a product of incidence matrices, some columns at a time.
        owner = np.repeat(np.arange(len(sets)), n)
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[code] > 1
        owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, (at, at + width))
            block = np.zeros((len(sets), width), np.float32)
            block[owner[a:b], code[a:b] - at] = 1
            common += block @ block.T
        both = common[i, j].astype(np.int64)
    else:
        both = np.empty(len(i), np.int64)
        for p, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            x, y = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
            both[p] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum() if len(y) else 0
    return 5 * both >= 4 * (n[i] + n[j] - both)


def passed(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """``rows`` without most of those whose digest is not among ``digests``; none is lost that is.

    A bitmap with a bit for each digest's hash is broadcast, of MOST_BITS at most, whatever the number of digests.
    """
    count = digests.count()
    buckets = min(MOST_BITS, max(BITMAP, 1 << (16 * count).bit_length())) // BITMAP
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(buckets * BITMAP))
    bits = digests.select(place("digest").alias("p")).groupBy(F.shiftright("p", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % BITMAP).alias("map"))
    marked = rows.withColumn("p", place("digest")).withColumn("bucket", F.shiftright("p", 15)).join(F.broadcast(bits), "bucket")
    # Bit i of a bitmap is bit i % 8 of its byte i / 8.
    byte = F.conv(F.hex(F.substr("map", F.shiftright(F.col("p") % BITMAP, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return marked.where(F.call_function("shiftright", byte, (F.col("p") % 8).cast("int")) % 2 == 1).drop("p", "bucket", "map")


def verified(found: DataFrame, reps: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(id, other, links): links of a class that a unit found, and another class of its tree there."""
    wanted = settle(found.select("id").distinct().join(reps.select("id", "digest"), "id"), "wanted")
    texts = passed(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.md5("text")), wanted)
    # One text a digest; where copies are many, they meet before they move.
    texts = texts.groupBy("digest").agg(F.min("text").alias("text"))
    # The candidates grow with the corpus, so at no size is their side broadcast: both are dealt by digest, and units by ranges.
    rows = found.join(wanted, "id").hint("merge").join(texts, "digest").repartitionByRange("unit").sortWithinPartitions("unit", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ("unit",)):
            unit, reps = t.column("unit").to_numpy(), t.column("id").to_numpy()
            t = t.take(np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (reps[1:] != reps[:-1])]))
            unit, reps = t.column("unit").to_numpy(), t.column("id").to_numpy()
            edges = np.append(np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]), len(unit))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(edges, edges[1:]):
                sets: list[np.ndarray] = []
                for part in slices(t.slice(a, b - a).combine_chunks().to_batches()[0], "text"):
                    h, doc = shingles(words(part.column("text")), SHINGLE)
                    sets += [np.unique(x) for x in np.split(h, np.searchsorted(doc, np.arange(1, part.num_rows)))]
                lists = t.column("partners").slice(a, b - a).combine_chunks()
                counts = np.diff(lists.offsets.to_numpy())
                i, j = np.repeat(np.arange(b - a), counts), np.searchsorted(reps[a:b], lists.flatten().to_numpy())
                ok = exact_links(sets, i, j)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                links = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
                tree = np.arange(b - a)
                while True:  # least neighbour, then jump
                    new = tree.copy()
                    np.minimum.at(new, i, tree[j])
                    np.minimum.at(new, j, tree[i])
                    new = new[new]
                    if (new == tree).all():
                        break
                    tree = new
                some = np.flatnonzero(links)
                out.append((reps[a:b][some], reps[a:b][tree[some]], links[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "other", "links"])

    return settle(rows.select("unit", "id", "partners", "text").mapInArrow(run, "id long, other long, links long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least member of each component of the edges (id, other)."""
    spark = edges.sparkSession
    both = settle(edges.select(F.col("id").alias("a"), F.col("other").alias("b")).union(edges.select("other", "id")).distinct(), "edges")
    path, labels = settled_at(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        pulled = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = labels.select(F.col("id").alias("mid"), F.col("label").alias("top"))
        after, stepped = settled_at(pulled.join(up, "mid", "left").select("id", "old", F.least("mid", "top").alias("label")), "labels")
        drop_path(spark, path)
        path, labels = after, stepped.select("id", "label")
        if stepped.where("label < old").limit(1).count() == 0:
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, text_class (least key with an equal text), class_id (least key of its near-duplicate class), n_links (different texts it is linked to)."""
    reps = sketches(docs, key, text)
    links = verified(candidates(reps), reps, docs, text)
    counts = links.groupBy("id").agg(F.sum("links").alias("n_links"))
    labels = components(links.where("id <> other").select("id", "other"))
    classes = settle(reps.select("digest", "id", "rep").join(labels, "id", "left").join(counts, "id", "left").select("digest", "rep", F.coalesce("label", "id").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    names = classes.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = classes.join(names, "label").select("digest", F.col("rep").alias("text_class"), "class_id", "n_links")
    rows = docs.select(F.col(key), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    return rows.join(named, "digest", "left").select(key, "text_class", "class_id", "n_links")
