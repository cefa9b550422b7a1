"""Even key ranges, so ordered work needs no single task; a key of many rows spans several ranges."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_KEY = -(1 << 63)
#: Bits of the number that orders the rows of one key.
TIE_BITS = 30


def boundaries(df: DataFrame, key: str, n: int) -> list[int]:
    """Ascending first keys of the ranges after the first, about ``n`` ranges of equal rows, however large n is.

    A key that stands in it m times has m ranges.  Null keys count as LEAST_KEY.  The driver holds one number a range.
    """
    if n <= 1:
        return []
    at = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(F.coalesce(F.col(key).cast("long"), F.lit(LEAST_KEY)), at, max(10_000, 4 * n)).alias("q")).first()["q"]
    return sorted(got or [])


def tie(text: Column, row: Column) -> Column:
    """A number below 2^TIE_BITS that spreads the rows of one key."""
    return F.pmod(F.xxhash64(text, row), F.lit(1 << TIE_BITS))


def range_of(key: Column, bounds: list[int], tie: Column | None = None) -> Column:
    """0-based index of the range that ``key`` is in; null keys are in the first.  Rows of one key are in order of ``tie``."""
    if not bounds:
        return F.lit(0)
    times = Counter(bounds)
    keys = sorted(times)
    ends = [0, *accumulate(times[k] for k in keys)]
    # Constants of the plan, folded once; two levels, so few comparisons a row.
    width = max(1, int(len(keys) ** 0.5))
    groups = [keys[i : i + width] for i in range(0, len(keys), width)]
    fixed = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)
    below = lambda values: F.size(F.filter(values, lambda x: x <= key))
    coarse = below(fixed([g[0] for g in groups], "array<bigint>"))
    place = (coarse - 1) * width + below(F.get(fixed(groups, "array<array<bigint>>"), coarse - 1))
    own, first, last = (F.get(fixed(v, "array<bigint>"), place - 1) for v in (keys, ends[:-1], ends[1:]))
    # A key that stands m times: its rows are spread over the m ranges that start there.
    among = F.shiftright((F.lit(0) if tie is None else tie).cast("long") * (last - first), TIE_BITS)
    inside = F.when(own == key, first + 1 + among).otherwise(last)
    return F.when(key.isNull() | (key < keys[0]), F.lit(0)).otherwise(inside).cast("int")


def locate(key: int | None, bounds: list[int], tie: int = 0) -> int:
    """The same for one key on the driver."""
    if key is None:
        return 0
    last, m = bisect_right(bounds, key), bounds.count(key)
    return last - m + 1 + (tie * m >> TIE_BITS) if m else last
