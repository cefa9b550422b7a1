"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-case runs of letters and digits (of ASCII; every other code point
counts as a letter).  The n-grams of two and of SEED words of every test item are counted in all documents, exactly.
An item is tiled with n-grams that overlap in one word at most, the tiling whose n-grams are rarest together, and these are
its seeds.  An unlike word or gap breaks at most as many tiles as it costs
in score, and there are more tiles than THRESHOLD leaves to lose, so that every
alignment of THRESHOLD holds a seed, however frequent the item's words are, and also where copies of the item fill the corpus.

Seeds are looked up in every document at every word.  Hits of one item on
neighbouring diagonals make a window, and if it has enough of the item's words, the item is
aligned locally with it: 1 for an equal word, -1 for an unequal one or a gap.  The score is the best alignment
over the item's words; documents with a score of ``THRESHOLD`` or more leak the item, if the alignment is worth ``LEAST_WORDS`` words at
least: fewer are no evidence, so shorter items are left out.

Test items are sent to the workers in blocks of at most ``BLOCK_WORDS`` words (some 150 MB); a larger
benchmark takes two passes over the documents a block.

Edge cases: null and empty texts hold nothing; items that are null, or have no id or fewer than LEAST_WORDS
words are left out; items that repeat are items of their own; of equal best
windows the first counts; rows with null or repeated keys are scored like others; an empty table or
benchmark gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrowmap import add_columns
from tessera.llm.kernels import Words, mix, slices, words
from tessera.llm.store import settle, ship, unused

SEED, THRESHOLD, LEAST_WORDS = 3, 0.5, 5
BLOCK_WORDS = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    code = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        code = code * _ODD + hashes[k : k + len(code)]
    return mix(code)


class Table:
    """Places of codes in a sorted table; most codes that are not there are told by a bitmap."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.mask = np.uint64((1 << max(16, (16 * len(codes)).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(codes & self.mask).astype(np.int64)] = True

    def grams(self, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words at which an n-gram stands that may be in the table, and their codes."""
        code = _grams(w.hash, n) ^ np.uint64(n)
        at = np.flatnonzero(self.maybe[(code & self.mask).astype(np.int64)])
        at = at[w.doc[at] == w.doc[at + n - 1]]
        return at, code[at]


def tiling(three: np.ndarray, two: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Places of the three- and two-word tiles of least total rate that cover all steps between words, with ``most`` tiles of two."""
    steps = len(two)
    best = np.full((steps + 1, most + 1), np.inf)
    best[0, 0] = 0
    for p in range(1, steps + 1):
        best[p, 1:] = best[p - 1, :-1] + two[p - 1]
        if p > 1:
            best[p] = np.minimum(best[p], best[p - 2] + three[p - 2])
    places, p, k = ([], []), steps, most
    while p:
        short = bool(k > 0 and best[p, k] == best[p - 1, k - 1] + two[p - 1])
        p, k = (p - 1, k - 1) if short else (p - 2, k)
        places[short].append(p)
    return places


class Items:
    """A block of test items: ids, word hashes, and, once ``choose`` has run, their seeds."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        w = words(pa.array(texts, pa.string()), punctuation=True)
        long = np.diff(w.bounds) >= LEAST_WORDS
        self.hash, self.ids = w.hash[long[w.doc]], np.array(ids, np.int64)[long]
        self.bounds = np.concatenate([[0], np.cumsum(np.diff(w.bounds)[long])])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams of all items, and whether each lies in one item."""
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        return _grams(self.hash, n) ^ np.uint64(n), item[: len(item) - n + 1] == item[n - 1 :]

    def vocabulary(self) -> np.ndarray:
        """The codes that are to be counted, sorted."""
        return np.unique(np.concatenate([code[inside] for code, inside in (self.grams(2), self.grams(SEED))]))

    def choose(self, counts: np.ndarray) -> None:
        """Pick the seeds, given how often each code of the vocabulary occurs."""
        vocabulary = self.vocabulary()
        code = {n: self.grams(n)[0] for n in (2, SEED)}
        often = {n: counts[np.minimum(np.searchsorted(vocabulary, c), len(vocabulary) - 1)].astype(float) for n, c in code.items()}
        codes, items, places = [], [], []
        for i, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            least = int((b - a) * (1 - THRESHOLD)) + 1  # tiles, of b - a - 1 steps
            three, two = tiling(often[SEED][a : b - SEED + 1], often[2][a : b - 1], 2 * least - (b - a - 1))
            for n, at in ((SEED, three), (2, two)):
                codes.append(code[n][a + np.array(at, np.int64)])
                places.append(np.array(at, np.int64))
                items.append(np.full(len(at), i))
        codes, items, places = (np.concatenate(x) for x in (codes, items, places))
        order = np.argsort(codes, kind="stable")
        self.items, self.places = items[order], places[order]
        self.table = Table(codes[order])


def align(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of rows of ``item`` with rows of ``window`` (0: padding), and where they end in the window."""
    n, m = item.shape[1], window.shape[1]
    ramp = np.arange(1, m + 1, dtype=np.int32)
    above = np.zeros((len(item), m + 1), np.int32)
    best, end = np.zeros(len(item), np.int32), np.zeros(len(item), np.int64)
    for i in range(n):
        same = (window == item[:, i : i + 1]) & (item[:, i : i + 1] != 0)
        row = np.maximum(above[:, :-1] + np.where(same, 1, -1).astype(np.int32), above[:, 1:] - 1)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        above[:, 1:] = row
        at = row.argmax(axis=1)
        top = row[np.arange(len(item)), at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


class Matcher:
    """Scores of the items in whole texts."""

    def __init__(self, items: Items) -> None:
        self.items = items

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, item and place in the item of every seed hit."""
        t = self.items
        found = []
        for n in (2, SEED):
            at, code = t.table.grams(w, n)
            a, b = np.searchsorted(t.table.codes, code, "left"), np.searchsorted(t.table.codes, code, "right")
            at, a, k = at[b > a], a[b > a], (b - a)[b > a]
            seed = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            found.append((np.repeat(at, k), t.items[seed], t.places[seed]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Text, item, score, first and last word (counted in the text) of the best window of each text and item hit."""
        t, w = self.items, words(column, punctuation=True)
        word, item, place = self.hits(w)
        empty = tuple(np.empty(0, k) for k in (np.int64, np.int64, float, np.int64, np.int64))
        if not len(word):
            return empty
        doc, diagonal, size = w.doc[word], word - place, np.diff(t.bounds)
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > size[item[1:]])]
        begin = np.flatnonzero(new)
        doc, item, lo = doc[begin], item[begin], diagonal[begin]
        hi = diagonal[np.append(begin[1:], len(diagonal)) - 1]
        length, text = size[item], w.bounds
        a = np.maximum(text[doc], lo - length // 2 - 2)
        b = np.minimum(text[doc + 1], hi + length + length // 2 + 2)
        score, first, last = np.zeros(len(doc)), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        turn = np.lexsort((b - a, length))
        at = 0
        while at < len(turn):
            stop = at + 1  # as many as fit a bounded table
            wide = b[turn[at]] - a[turn[at]]
            while stop < len(turn) and (stop - at + 1) * (wide := max(wide, b[turn[stop]] - a[turn[stop]])) <= 1 << 18:
                stop += 1
            some = turn[at:stop]
            at = stop
            x, y = self._rows(t.hash, t.bounds[item[some]], t.bounds[item[some] + 1]), self._rows(w.hash, a[some], b[some])
            # An alignment of THRESHOLD has at least that share of the item's words.
            shared = sum(((y == c[:, None]) & (c[:, None] != 0)).any(axis=1).astype(np.int64) for c in x.T)
            enough = shared >= np.maximum(THRESHOLD * length[some], LEAST_WORDS)
            if not enough.any():
                continue
            some, x, y = some[enough], x[enough], y[enough]
            best, end = align(x, y)
            back = self._rows(w.hash, a[some], a[some] + end)
            flip = np.zeros_like(back)
            for r, n in enumerate(end):
                flip[r, :n] = back[r, :n][::-1]
            turned = np.zeros_like(x)
            for r, n in enumerate(length[some]):
                turned[r, :n] = x[r, :n][::-1]
            reach = align(turned, flip)[1] if flip.shape[1] else np.zeros(len(some), np.int64)
            score[some] = np.where(best >= LEAST_WORDS, best / length[some], 0)
            last[some] = a[some] + end - 1 - text[doc[some]]
            first[some] = a[some] + end - reach - text[doc[some]]
        order = np.lexsort((first, -score, item, doc))
        order = order[score[order] > 0]
        if not len(order):
            return empty
        order = order[np.r_[True, (np.diff(doc[order]) > 0) | (np.diff(item[order]) != 0)]]
        return doc[order], item[order], score[order], first[order], last[order]

    @staticmethod
    def _rows(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = b - a
        span = np.arange(int(n.max(initial=0)))
        rows = values[np.minimum(a[:, None] + span, max(0, len(values) - 1))]
        rows[span >= n[:, None]] = 0
        return rows


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    """The test items in blocks of at most BLOCK_WORDS words (or one longer item)."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long"), text).orderBy(item, text).toLocalIterator():
        n = len(r[1]) // 2 + 1
        if ids and size + n > BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += n
    if ids:
        yield Items(ids, texts)


def gram_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each code of the (sorted) vocabulary occurs in all documents."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = Table(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                w = words(part.column("t"), punctuation=True)
                for n in (2, SEED):
                    code = table.grams(w, n)[1]
                    at = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
                    seen += np.bincount(at[vocabulary[at] == code], minlength=len(vocabulary))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["w", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(vocabulary), np.int64)
    counts[rows.column("w").to_numpy()] = rows.column("n").to_numpy()
    return counts


def prepared(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str) -> Iterator[Items]:
    for block in blocks(benchmark, item, item_text):
        if len(block.ids):
            block.choose(gram_counts(docs, text, block.vocabulary()))
            yield block


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document and test item that it leaks: key, item, score, first_word, last_word."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(item, T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])

    def found(block: Items) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(block)
            for batch in batches:
                for part in slices(batch, "t"):
                    doc, of, score, first, last = match(part.column("t"))
                    keep = score >= THRESHOLD
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(doc[keep])), pa.array(block.ids[of[keep]]), pa.array(score[keep]), pa.array(first[keep]), pa.array(last[keep])], schema.names)

        return rows.mapInArrow(run, schema)

    out = None
    for block in prepared(docs, benchmark, text, item, item_text):
        new = found(block)
        out = new if out is None else settle(out, "leaks").unionByName(new)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that leak an item; rows do not move."""
    leak, out = unused(docs, "_leak"), docs
    field = [T.StructField(leak, T.DoubleType())]
    for block in prepared(docs, benchmark, text, item, item_text):

        def make(block: Items = block):
            match = Matcher(block)

            def run(column: pa.Array) -> list:
                doc, _, score, _, _ = match(column)
                worst = np.zeros(len(column))
                np.maximum.at(worst, doc, score)
                return [worst]

            return run

        out = add_columns(out, text, field, make).where(F.col(leak) < THRESHOLD).drop(leak)
    return out
