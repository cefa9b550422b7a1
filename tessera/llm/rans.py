"""Range asymmetric numeral system over static tables, numpy form.

A block holds up to ``BLOCK`` symbols dealt in turn to ``LANES`` interleaved
coders that share one frequency table and one word stream.  Blocks do not depend
on each other; many are coded in step as one array.  Inside a block, every
``CHECKPOINT`` steps the coder states and the place in the word stream are kept,
so decoding can start there.

A state lies in [2^31, 2^63); words of 32 bits move it back into that range.
"""

from __future__ import annotations

import zlib

import numpy as np

SCALE = 18
LANES, BLOCK, CHECKPOINT = 64, 32768, 256
_LOW = np.uint64(1 << 31)
_S, _32 = np.uint64(SCALE), np.uint64(32)
_MASK, _WORD = np.uint64((1 << SCALE) - 1), np.uint64(0xFFFFFFFF)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^SCALE; a symbol that occurs gets at least 1.  All zeros if nothing occurs."""
    counts = np.asarray(counts, np.int64)
    total, whole = int(counts.sum()), 1 << SCALE
    if total == 0:
        return np.zeros(len(counts), np.int64)
    if (counts > 0).sum() > whole:
        raise ValueError("more symbols than the table has slots")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (whole / total)).astype(np.int64)), 0)
    order = np.argsort(-counts, kind="stable")
    gap = whole - int(freq.sum())
    while gap:
        if gap > 0:
            freq[order[0]] += gap
            break
        room = np.maximum(freq[order] - 1, 0)
        cut = np.minimum(room, -(gap // max(1, (room > 0).sum())))
        spent = np.cumsum(cut)
        cut[spent > -gap] = 0
        if not cut.any():
            cut[int(np.flatnonzero(room > 0)[0])] = 1
        freq[order] -= cut
        gap += int(cut.sum())
    return freq


class Coder:
    """Encoder and decoder for one table of frequencies."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.pad = int(freq.argmax())
        #: Tells this table from others.
        self.check = zlib.crc32(np.ascontiguousarray(freq, "<u4"))

    def encode(self, ids: np.ndarray) -> list[dict]:
        """Blocks of ``ids``: n, crc32 of the ids, words, and checkpoints (place in the words, states)."""
        blocks = -(-len(ids) // BLOCK)
        if not blocks:
            return []
        steps = BLOCK // LANES if blocks > 1 else -(-len(ids) // LANES)
        padded = np.full(blocks * steps * LANES, self.pad, np.uint32)
        padded[: len(ids)] = ids
        grid = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
        if not self.freq[grid].all():
            raise ValueError("a symbol has no frequency")
        state = np.full(grid.shape[1], _LOW, np.uint64)
        out, moved = np.zeros(grid.shape, np.uint32), np.zeros(grid.shape, bool)
        kept = {}
        limit = np.uint64(1 << (63 - SCALE))
        for t in range(steps - 1, -1, -1):
            f, b = self.freq[grid[t]], self.base[grid[t]]
            full = state >= f * limit
            moved[t] = full
            out[t] = state & _WORD
            state = np.where(full, state >> _32, state)
            whole = state // f
            state = (whole << _S) + (state - whole * f) + b
            if t % CHECKPOINT == 0:
                kept[t] = state.copy()
        made = []
        for k in range(blocks):
            lanes = slice(k * LANES, (k + 1) * LANES)
            mine = moved[:, lanes]
            words = out[:, lanes][mine]
            place = np.concatenate([[0], np.cumsum(mine.sum(axis=1))])
            part = np.ascontiguousarray(ids[k * BLOCK : (k + 1) * BLOCK], "<u4")
            made.append({"n": len(part), "steps": steps, "crc": zlib.crc32(part), "words": words, "at": np.array([place[t] for t in sorted(kept)], np.uint32), "states": np.stack([kept[t][lanes] for t in sorted(kept)])})
        return made

    def decode(self, blocks: list[dict], first: int = 0, stop: int | None = None) -> list[np.ndarray]:
        """Ids of each block from checkpoint ``first`` on, up to id ``stop`` or somewhat beyond; blocks of equal steps are decoded in step."""
        done: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
        for steps in sorted({b["steps"] for b in blocks}):
            some = [i for i, b in enumerate(blocks) if b["steps"] == steps]
            words = np.concatenate([*(blocks[i]["words"] for i in some), np.zeros(LANES, np.uint32)])
            begin = np.cumsum([0, *(len(blocks[i]["words"]) for i in some)])[:-1]
            ptr = begin + np.array([int(blocks[i]["at"][first]) for i in some])
            state = np.concatenate([blocks[i]["states"][first] for i in some])
            last = steps if stop is None else min(steps, -(-stop // LANES))
            grid = np.empty((last - first * CHECKPOINT, len(some) * LANES), np.uint32)
            for t in range(len(grid)):
                slot = state & _MASK
                sym = self.symbol[slot]
                grid[t] = sym
                state = self.freq[sym] * (state >> _S) + slot - self.base[sym]
                short = state < _LOW
                rank = np.cumsum(short.reshape(len(some), LANES), axis=1)
                place = (ptr[:, None] + rank - 1).ravel()
                state[short] = (state[short] << _32) | words[place[short]].astype(np.uint64)
                ptr = ptr + rank[:, -1]
            ids = grid.reshape(len(grid), len(some), LANES).transpose(1, 0, 2).reshape(len(some), -1)
            for row, i in enumerate(some):
                done[i] = ids[row, : max(0, blocks[i]["n"] - first * CHECKPOINT * LANES)]
                if first == 0 and last == steps and zlib.crc32(np.ascontiguousarray(done[i], "<u4")) != blocks[i]["crc"]:
                    raise ValueError("a block's checksum does not hold")
        return done
