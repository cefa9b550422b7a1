"""Ids of word-like spans, each distinct span worked out once."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np

from tessera.llm.kernels import Words


def _groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, ascending; a place that has each; for each place the number of its hash."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


#: Bytes that may be read beyond a span, and masks of the first bytes of eight.
_PAD = 8
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
if sys.byteorder == "big":
    _FIRST = _FIRST.byteswap()


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> bool:
    """Whether the ``size`` bytes of ``a`` from ``at`` on are those of ``b`` from ``bt`` on, for all spans; both go on for _PAD bytes after the spans."""
    x, y = (np.ndarray(len(v) - 7, np.uint64, v, strides=(1,)) for v in (a, b))
    while len(size):
        if ((x[at] ^ y[bt]) & _FIRST[np.minimum(size, 8)]).any():
            return False
        left = np.flatnonzero(size > 8)
        at, bt, size = at[left] + 8, bt[left] + 8, size[left] - 8
    return True


class SpanCache:
    """Remembers the ids that ``learn`` gives for spans of bytes: all of them in one array, and how many each span has.

    Spans are found by their hashes, in one pass over all of a call; the bytes of all are compared.
    """

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int) -> None:
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        #: Ascending hashes, and the span of each.
        self.hash, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        self.bytes, self.filled = np.empty(1 << 22, np.uint8), 0
        #: Of each span: its first id, how many it has, its first byte, how many it has.
        self.at, self.size, self.begin, self.long = (np.empty(1 << 19, np.int64) for _ in range(4))

    def _add(self, hashes: np.ndarray, spans: list[bytes]) -> np.ndarray:
        """The places of new spans, whose hashes ascend."""
        flat, size = self.learn(spans)
        k, n = len(self.hash), len(spans)
        raw = np.frombuffer(b"".join(spans), np.uint8)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.filled + len(raw) + _PAD > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.empty_like(self.bytes)])
        while k + n > len(self.at):
            self.at, self.size, self.begin, self.long = (np.concatenate([x, x]) for x in (self.at, self.size, self.begin, self.long))
        self.ids[self.used : self.used + len(flat)] = flat
        self.bytes[self.filled : self.filled + len(raw)] = raw
        long = np.array([len(s) for s in spans], np.int64)
        self.at[k : k + n], self.size[k : k + n] = self.used + np.cumsum(size) - size, size
        self.begin[k : k + n], self.long[k : k + n] = self.filled + np.cumsum(long) - long, long
        self.used, self.filled = self.used + len(flat), self.filled + len(raw)
        into = np.searchsorted(self.hash, hashes)
        self.hash, self.place = np.insert(self.hash, into, hashes), np.insert(self.place, into, np.arange(k, k + n))
        return np.arange(k, k + n)

    def _spans(self, w: Words) -> tuple[np.ndarray, ...]:
        """An array of ids; for each span its first one there, and how many it has."""
        raw, long = w.data.tobytes(), w.end - w.start
        data = np.concatenate([w.data, np.zeros(_PAD, np.uint8)])
        hashes, first, inverse = _groups(w.hash)
        like = first[inverse]
        twin = np.flatnonzero(like != np.arange(len(like)))
        like = like[twin]
        same = bool((long[twin] == long[like]).all()) and _same(data, w.start[twin], data, w.start[like], long[like])
        near = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        known = self.hash[near] == hashes if len(self.hash) else np.zeros(len(hashes), bool)
        place = np.full(len(hashes), -1)
        if same and known.any():
            place[known] = self.place[near[known]]
            mine, theirs = first[known], place[known]
            same = bool((long[mine] == self.long[theirs]).all()) and _same(data, w.start[mine], self.bytes, self.begin[theirs], long[mine])
        if not same:  # two spans of one hash: nothing of this call is remembered
            places: dict[bytes, int] = {}
            found = np.array([places.setdefault(raw[a:b], len(places)) for a, b in zip(w.start.tolist(), w.end.tolist())], np.int64)
            flat, size = self.learn(list(places))
            return np.asarray(flat, np.uint32), (np.cumsum(size) - size)[found], np.asarray(size, np.int64)[found]
        if not known.all():
            new = first[~known]
            place[~known] = self._add(hashes[~known], [raw[a:b] for a, b in zip(w.start[new].tolist(), w.end[new].tolist())])
        place = place[inverse]
        return self.ids, self.at[place], self.size[place]

    def __call__(self, w: Words, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (each followed by ``end``, if given), and how many each text has."""
        if len(self.hash) > self.most or self.used > 8 * self.most:
            self.clear()
        n = len(w.offsets) - 1
        ids, at, size = self._spans(w)
        total = np.bincount(w.doc, size, n).astype(np.int64) + (end is not None)
        ends = np.cumsum(total)
        source = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if end is None:
            return ids[source], total
        out = np.full(int(ends[-1]) if n else 0, end, np.uint32)
        into = np.ones(len(out), bool)
        into[ends - 1] = False
        out[into] = ids[source]
        return out, total
