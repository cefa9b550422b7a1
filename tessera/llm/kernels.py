"""Numpy kernels over Arrow string batches: words, word hashes and shingles.

Everything here works on whole texts in slices of a few megabytes, so memory
follows the slice (or the one text that is longer), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``most`` bytes."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the n + 1 offsets of the texts in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _gap_table(punctuation: bool) -> np.ndarray:
    gap = np.zeros(256, bool)
    gap[:33] = True
    if punctuation:
        for b in range(33, 128):
            gap[b] = not chr(b).isalnum()
    return gap


_GAPS = {False: _gap_table(False), True: _gap_table(True)}


@dataclass
class Words:
    """Words of several texts: byte spans in ``data``, the text each is of, a 64-bit hash."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """n + 1 indices of the first word of each text."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))


def _spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, first: np.ndarray, last: np.ndarray) -> Words:
    """Words from the flags of their first and last bytes, cut where texts meet."""
    n = len(data)
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    code = (sums[end] - sums[start]) * down[start]
    return Words(data, offsets, start, end, doc, mix(code + (end - start).astype(np.uint64)))


def words(column: pa.Array, lower: bool = True, punctuation: bool = False) -> Words:
    """Words are runs of bytes above the ASCII space (with ``punctuation``: of letters, digits and non-ASCII)."""
    data, offsets = text_bytes(column, lower)
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_GAPS[punctuation][data], out=inside[:n])
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    last = inside[:n] & ~inside[1:]
    return _spans(data, offsets, inside, first, last)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte kinds: 0 white space, 1 letter, 2 digit, 3 punctuation, 4 apostrophe, 5 beyond ASCII.
_KIND = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 5 if b > 127 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 if b == 39 else 3 for b in range(256)], np.uint8)
_CUTS = np.zeros((6, 6), bool)
_CUTS[1, 2:5] = _CUTS[2, [1, 3, 4]] = _CUTS[3, 1:3] = True


def pieces(column: pa.Array) -> Words:
    """Words with ASCII letters in lower case, also cut between ASCII letters, digits and punctuation.

    No cut follows an apostrophe or stands beside a non-ASCII byte, so a tokenizer
    that lower-cases and separates letters, digits and symbols yields the same ids
    for the pieces as for the text.
    """
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    n = len(data)
    kind = np.zeros(n + 1, np.uint8)
    kind[:n] = _KIND[data]
    inside = kind > 0
    cut = _CUTS.ravel()[kind[: n - 1] * np.uint8(6) + kind[1:n]] if n > 1 else np.empty(0, bool)
    first, last = inside[:n].copy(), inside[:n] & ~inside[1:]
    first[1:] &= ~inside[: n - 1] | cut
    last[: n - 1] |= cut
    return _spans(data, offsets, inside, first, last)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``size`` words; a text of fewer words has one shingle of them all."""
    n = len(w.hash)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code[: n - k] = code[: n - k] * _ODD + w.hash[k:] if k < n else code[: n - k]
    whole = np.zeros(n, bool)
    if n >= size:
        whole[: n - size + 1] = w.doc[: n - size + 1] == w.doc[size - 1 :]
    bounds = w.bounds
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < size))
    out, doc = mix(code[whole]), w.doc[whole]
    if len(short):
        few = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            value = 0
            for h in w.hash[bounds[d] : bounds[d + 1]]:
                value = (value * int(_ODD) + int(h) + 1) & 0xFFFFFFFFFFFFFFFF
            few[i] = value
        out, doc = np.concatenate([out, mix(few)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc
