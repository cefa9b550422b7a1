"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces are read from a SentencePiece model file.  A model whose scores are
merge ranks (a BPE model) has no log scores; its pieces get the Zipf log
probability of their rank, -ln((rank + 1) H), pieces barred from merging the last rank.
White space becomes the marker, one marker goes before a non-empty text if the model asks for it, and a code point that no
piece covers is spelled with byte pieces, at the lowest score less 10.  Models that rewrite texts in other ways
(a character map, fewer spaces) are refused.

The best path of a text is the concatenation of the best paths of its spans, where a cut
stands between two characters, of whatever script, that are neighbours in no piece.  So texts are
cut into such spans, and the Viterbi search runs once for each distinct span, for many
spans in step: one numpy operation advances all of them in the trie by a byte.  A long span is
searched alone: the trie is stepped for all of its bytes at once, then its edges are followed.

Edge cases: null and empty texts have no pieces and decode to the empty text; a
marker character in a text decodes to a space, as in the library; NUL and other
controls go through byte pieces.  Ties between paths go to the one whose last piece starts
earlier.  Rows are encoded independently.  Extra columns are carried along, except ones
named like the results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.arrowmap import add_columns
from tessera.llm.cache import SpanCache
from tessera.llm.kernels import Words, _spans, text_bytes

MARKER = "▁"
#: Spans a Python worker remembers; bytes of a span from which it is searched alone.
REMEMBERED, LONG = 250_000, 200
_CACHES: dict[str, SpanCache] = {}
#: Bits of the table of neighbours: two pairs of one code only make a cut fewer.
_BITS = 22


@dataclass
class Vocabulary:
    """``texts``: bytes of each piece, the marker as a space; ``byte``: id of each byte piece; the trie's arrays."""

    texts: list[bytes]
    scores: np.ndarray
    byte: np.ndarray
    unknown: int
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    together: np.ndarray
    lead: bool
    key: str


def log_scores(scores: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Log scores of the normal pieces: as they are, or from ranks (see above)."""
    s = scores[normal]
    usable = s > -1e6
    ranks = bool(len(s)) and bool((s[usable] == -np.round(-s[usable])).all()) and bool((s[usable] <= 0).all()) and s[usable].min(initial=0) < -100
    out = np.zeros(len(scores), np.float32)
    if not ranks:
        out[normal] = s
        return out
    rank = np.where(usable, -s, -s[usable].min(initial=0) + 1)
    out[normal] = -np.log(rank + 1) - np.log((1.0 / np.arange(1, len(s) + 1)).sum())
    return out


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value (-1: none) arrays: child c of state s is base[s] + c if check there is s."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for k, v in zip(keys, values):
        node = 0
        for c in k:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                value.append(-1)
            node = children[node][c]
        value[node] = v
    size = 2 * len(children) + 1024
    base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    out[0] = value[0]
    todo, free = [(0, 0)], 257
    for node, state in todo:
        codes = sorted(children[node])
        if not codes:
            continue
        b = tried = max(1, free - codes[0])
        while any(taken[b + c] for c in codes):
            b += 1
            if b + 512 > len(taken):
                base, check, out = (np.concatenate([a, np.full(size, f, np.int32)]) for a, f in ((base, 0), (check, -1), (out, -1)))
                taken.extend(bytes(size))
        if b - tried > 64:  # full up to here, but for gaps that fit nothing
            free = b + codes[0]
        base[state] = b
        for c in codes:
            taken[b + c] = 1
            check[b + c] = state
            out[b + c] = value[children[node][c]]
            todo.append((children[node][c], b + c))
    end = max(i for i, t in enumerate(taken) if t) + 257
    return base[:end], check[:end], out[:end]


def _fields(raw: bytes) -> list[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protobuf message."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            c = raw[at]
            at += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            out.append((tag >> 3, varint()))
            continue
        n = {1: 8, 5: 4}.get(tag & 7) or varint()
        out.append((tag >> 3, raw[at : at + n]))
        at += n
    return out


def _settings(raw: bytes) -> dict[int, int | bytes]:
    """The normaliser's settings of a model file: 2 character map, 3 leading marker, 4 fewer spaces, 5 spaces become markers (fixed values of the format)."""
    found = [v for k, v in _fields(raw) if k == 3]
    return {2: b"", 3: 1, 4: 1, 5: 1} | (dict(_fields(found[0])) if found else {})


def _codes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Codes of _BITS bits for pairs of code points; pairs of ASCII have codes of their own."""
    mixed = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + after.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BITS)
    return np.where((before < 128) & (after < 128), before.astype(np.uint64) << np.uint64(7) | after.astype(np.uint64), np.maximum(mixed, np.uint64(1 << 14))).astype(np.int64)


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    settings = _settings(raw)
    if settings[2] or settings[4] or not settings[5]:
        raise ValueError("the model's normaliser rewrites texts")
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    normal = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    scores = log_scores(np.array([model.get_score(i) for i in range(n)]), normal)
    byte = np.full(256, model.unk_id(), np.int64)
    texts = []
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte[int(name[1:-1], 16)] = i
            texts.append(bytes([int(name[1:-1], 16)]))
        else:
            texts.append(name.replace(MARKER, " ").encode() if normal[i] else b"")
    ids = sorted(np.flatnonzero(normal).tolist(), key=lambda i: texts[i])
    shown = [texts[i].decode() for i in ids]
    pairs = [(ord(x), ord(y)) for t in shown for x, y in zip(t, t[1:])]
    together = np.zeros(1 << _BITS, bool)
    if pairs:
        together[_codes(*np.array(pairs, np.int64).T)] = True
    return Vocabulary(texts, scores, byte, model.unk_id(), *double_array([texts[i] for i in ids], ids), together, bool(settings[3]), hashlib.sha256(raw).hexdigest())


class Viterbi:
    """Best piece ids of spans of bytes."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        normal = v.piece[v.piece >= 0]
        self.scores = v.scores.astype(np.float64)
        self.floor = float(self.scores[normal].min() - 10) if len(normal) else -10.0
        self.size = np.zeros(256, np.int64)
        self.size[:0x80], self.size[0xC0:0xE0], self.size[0xE0:0xF0], self.size[0xF0:] = 1, 2, 3, 4

    def __call__(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans, and how many each has."""
        lengths = np.array([len(s) for s in spans], np.int64)
        order = np.argsort(lengths, kind="stable")
        found, sizes, at = [], np.zeros(len(spans), np.int64), 0
        while at < len(order):
            n = lengths[order[at]]
            if n >= LONG:
                ids = np.array(self._alone(spans[order[at]]), np.uint32)
                stop, size = at + 1, np.array([len(ids)])
            else:
                stop = min(at + 8192, int(np.searchsorted(lengths[order], min(n + 8, LONG - 1), side="right")))
                ids, size = self._paths([spans[i] for i in order[at:stop].tolist()])
            sizes[order[at:stop]] = size
            found.append(ids)
            at = stop
        # From the order of lengths back to that of the spans.
        flat, own = np.concatenate([np.empty(0, np.uint32), *found]), sizes[order]
        begin = np.empty(len(spans), np.int64)
        begin[order] = np.cumsum(own) - own
        return flat[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes

    def _together(self, spans: list[bytes]) -> list[list[int]]:
        ids, sizes = self._paths(spans)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]

    def _paths(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Spans of like lengths, all in step."""
        v, m = self.v, len(spans)
        length = np.array([len(s) for s in spans])
        width = int(length.max())
        grid = np.zeros((m, width + 4), np.uint8)
        grid[:, :width][np.arange(width) < length[:, None]] = np.frombuffer(b"".join(spans), np.uint8)
        best = np.full((m, width + 5), -np.inf)
        best[:, 0] = 0
        back = np.zeros((m, width + 5), np.int32)
        used = np.full((m, width + 5), -1, np.int32)
        for s in range(width):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (length > s))
            if not len(rows):
                continue
            char = self.size[grid[rows, s]]
            single = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            from_here = best[rows, s]
            d = 0
            while len(live):
                ok = s + d < length[rows[live]]
                live, state = live[ok], state[ok]
                if not len(live):
                    break
                to = v.base[state] + grid[rows[live], s + d]
                ok = v.check[to] == state
                live, state = live[ok], to[ok]
                d += 1
                ends = v.piece[state]
                hit = np.flatnonzero(ends >= 0)
                if len(hit):
                    r, p = live[hit], ends[hit]
                    single[r] |= char[r] == d
                    score = from_here[r] + self.scores[p]
                    better = score > best[rows[r], s + d]
                    r, p, score = r[better], p[better], score[better]
                    best[rows[r], s + d], back[rows[r], s + d], used[rows[r], s + d] = score, s, p
            r = np.flatnonzero(~single)
            if len(r):
                to = np.minimum(s + char[r], length[rows[r]])
                score = from_here[r] + self.floor
                better = score > best[rows[r], to]
                r, to, score = r[better], to[better], score[better]
                best[rows[r], to], back[rows[r], to], used[rows[r], to] = score, s, -1
        # Back along the best paths, a piece of every span at a time.
        rows, at, steps = np.arange(m), length.copy(), []
        while len(rows):
            start = back[rows, at]
            steps.append((rows, start, at, used[rows, at]))
            rows, at = rows[start > 0], start[start > 0]
        rows, start, end, piece = (np.concatenate(c) for c in zip(*steps))
        order = np.lexsort((start, rows))
        rows, start, end, piece = rows[order], start[order], end[order], piece[order]
        count = np.where(piece >= 0, 1, end - start)
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        of = np.repeat(np.arange(len(rows)), count)
        ids = np.where(piece[of] >= 0, piece[of], v.byte[grid[rows[of], start[of] + nth]])
        return ids.astype(np.uint32), np.bincount(rows, count, m).astype(np.int64)

    def _alone(self, s: bytes) -> list[int]:
        """The same for one long span, some thousand bytes at a time."""
        v, n = self.v, len(s)
        data = np.frombuffer(s, np.uint8)
        size = self.size[data].tolist()
        best: list[float] = [0.0, *[float("-inf")] * (n + 4)]
        back, used = [0] * (n + 5), [-1] * (n + 5)
        scores, floor = self.scores, self.floor
        for begin in range(0, n, 1 << 14):
            # All edges from these bytes: pieces that start at them.
            at = np.arange(begin, min(n, begin + (1 << 14)))
            state, d, edges = np.zeros(len(at), np.int32), 0, []
            while len(at):
                ok = at + d < n
                at, state = at[ok], state[ok]
                to = v.base[state] + data[at + d]
                ok = v.check[to] == state
                at, state = at[ok], to[ok]
                d += 1
                hit = np.flatnonzero(v.piece[state] >= 0)
                edges.append((at[hit], np.full(len(hit), d), v.piece[state[hit]]))
            start, length, piece = (np.concatenate(c) for c in zip(*edges))
            order = np.lexsort((length, start))
            start, length, piece = start[order], length[order].tolist(), piece[order]
            worth, piece = scores[piece].tolist(), piece.tolist()
            first = np.searchsorted(start, np.arange(begin, min(n, begin + (1 << 14)) + 1)).tolist()
            for a in range(begin, min(n, begin + (1 << 14))):
                here = best[a]
                if here == float("-inf"):
                    continue
                char, single = size[a], False
                for e in range(first[a - begin], first[a - begin + 1]):
                    to = a + length[e]
                    single = single or length[e] == char
                    score = here + worth[e]
                    if score > best[to]:
                        best[to], back[to], used[to] = score, a, piece[e]
                if not single:
                    to = min(a + char, n)
                    if here + floor > best[to]:
                        best[to], back[to], used[to] = here + floor, a, -1
        ids: list[int] = []
        at = n
        while at > 0:
            a = back[at]
            ids.extend([used[at]] if used[at] >= 0 else [int(v.byte[c]) for c in reversed(s[a:at])])
            at = a
        return ids[::-1]


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points whose first bytes are at ``at``."""
    b = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    lead = data[at].astype(np.int64)
    two, three, four = (lead & 0x1F) << 6 | b[1], (lead & 0x0F) << 12 | b[1] << 6 | b[2], (lead & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]
    return np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)))


def cuts(v: Vocabulary, data: np.ndarray) -> np.ndarray:
    """Whether a cut may stand after each byte but the last: between characters that are neighbours in no piece."""
    a, b = data[:-1], data[1:]
    cut = np.zeros(len(a), bool)
    plain = (a < 128) & (b < 128)
    cut[plain] = ~v.together[a[plain].astype(np.int64) << 7 | b[plain]]
    at = np.flatnonzero(~plain & ((b & 0xC0) != 0x80))
    if len(at):
        # The character before starts one to four bytes back.
        back = at.copy()
        for _ in range(3):
            inner = (data[back] & 0xC0) == 0x80
            back[inner] -= 1
        cut[at] = ~v.together[_codes(_code_points(data, back), _code_points(data, at + 1))]
    return cut


def spans(v: Vocabulary, column: pa.Array) -> Words:
    """The texts with markers as spaces, cut where no piece crosses."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.replace_substring(column, MARKER, " ")
    if v.lead:
        blank, marker = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        column = pc.if_else(pc.equal(column, blank), blank, pc.binary_join_element_wise(marker, column, blank))
    data, offsets = text_bytes(column)
    n = len(data)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    inside = np.ones(n + 1, bool)
    if n:
        cut = cuts(v, data)
        first[0] = last[-1] = True
        first[1:], last[:-1] = cut, cut
    return _spans(data, offsets, inside, first, last)


def encode(docs: DataFrame, v: Vocabulary, text: str = "text", into: str = "pieces", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the piece ids of each whole text, as little-endian 32-bit integers in a binary column."""

    def make():
        if v.key not in _CACHES:
            _CACHES[v.key] = SpanCache(Viterbi(v), REMEMBERED)
        cache = _CACHES[v.key]

        def run(column: pa.Array) -> list:
            ids, total = cache(spans(v, column))
            ends = np.concatenate([[0], np.cumsum(total) * 4]).astype(np.int32)
            return [pa.Array.from_buffers(pa.binary(), len(total), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])]

        return run

    return add_columns(docs, text, [T.StructField(into, T.BinaryType())], make, keep, most=1 << 19)


def decode(coded: DataFrame, v: Vocabulary, pieces: str = "pieces", into: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``coded`` with the text of each row's piece ids; bytes that are no UTF-8 become U+FFFD."""
    sizes = np.array([len(t) for t in v.texts])
    begin = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"".join(v.texts), np.uint8)

    def make():
        def run(column: pa.Array) -> list:
            column = pc.fill_null(column, b"")
            _, at, data = column.buffers()
            at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            ids = (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)).view("<u4")
            n = sizes[ids]
            source = np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            raw = joined[source]
            ends = np.concatenate([[0], np.cumsum(n)])[(at - at[0]) // 4]
            # The marker before a text goes.
            a, b = ends[:-1], ends[1:]
            lead = v.lead & (a < b) & (raw[np.minimum(a, max(0, len(raw) - 1))] == 32) if len(raw) else np.zeros(len(a), bool)
            stay = np.ones(len(raw), bool)
            stay[a[lead]] = False
            ends = np.concatenate([[0], np.cumsum((b - a) - lead)])
            raw = raw[stay]
            made = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
            try:
                return [made.cast(pa.string())]
            except pa.ArrowInvalid:
                return [[x.decode("utf-8", "replace") for x in made.to_pylist()]]

        return run

    return add_columns(coded, pieces, [T.StructField(into, T.StringType())], make, keep, most=1 << 20)
