"""Exact order statistics by repeated histograms: each pass narrows the range of every wanted rank by 65,536.

A double's bits, with the sign made to sort, are a whole number of 64 bits. A pass counts, among the values whose
leading bits are those of a wanted rank, the next 16 bits; partial counts are made per task, and the driver sees at most
65,536 counters a rank, whatever the number of values. A rank is found once the counter that holds it has one value,
after four passes at the latest. No task holds or sorts the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, TOP = 16, 1 << 63


def ordered(values):
    """The sortable unsigned 64-bit numbers of an array of doubles; zeros are one value, and so are NaNs (the largest)."""
    import numpy as np

    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.uint64)
    return np.where(bits >= np.uint64(TOP), ~bits, bits | np.uint64(TOP))


def double(key: int) -> float:
    import numpy as np

    return float(np.array([key - TOP if key >= TOP else ~key & (2**64 - 1)], np.uint64).view(np.float64)[0])


def _pass(values: DataFrame, level: int, prefixes: list[int]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(prefix, next bits) to count, smallest and largest key."""
    shift = 64 - BITS * (level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: dict[int, tuple] = {}
        for b in batches:
            keys, n = np.unique(ordered(b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)), return_counts=True)
            for p in prefixes:
                low, high = (np.searchsorted(keys, np.uint64(x)) if x < 2**64 else len(keys) for x in (p << shift + BITS, (p + 1) << shift + BITS))
                own, mine = keys[low:high], n[low:high]
                if len(own):
                    at = ((own >> np.uint64(shift)) & np.uint64(2**BITS - 1)).astype(np.int64)
                    count, least, most = held.setdefault(p, (np.zeros(1 << BITS, np.int64), np.full(1 << BITS, 2**64 - 1, np.uint64), np.zeros(1 << BITS, np.uint64)))
                    np.add.at(count, at, mine)
                    np.minimum.at(least, at, own)
                    np.maximum.at(most, at, own)
        for p, (count, least, most) in held.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([str(p)] * len(at)), pa.array(at), pa.array(count[at]), pa.array([f"{x:020d}" for x in least[at].tolist()]), pa.array([f"{x:020d}" for x in most[at].tolist()])], names=["p", "b", "n", "low", "high"])

    told = values.mapInArrow(run, "p string, b long, n long, low string, high string").groupBy("p", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {(int(r["p"]), r["b"]): (r["n"], int(r["low"]), int(r["high"])) for r in told.collect()}  # at most 65,536 rows a prefix


def at_ranks(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at ranks (from 0) among the doubles of the one column, none of them null."""
    wanted, found = {r: (0, r) for r in set(ranks)}, {}  # rank to its prefix and its rank among that prefix's values
    for level in range(64 // BITS):
        counters = _pass(values, level, sorted({p for p, _ in wanted.values()}))
        chains: dict[int, list] = {}
        for (p, b), c in sorted(counters.items()):
            chains.setdefault(p, []).append((b, *c))
        for rank, (p, left) in list(wanted.items()):
            for b, n, low, high in chains[p]:
                if left < n:
                    if low == high:
                        found[rank] = double(low)
                        del wanted[rank]
                    else:
                        wanted[rank] = (p << BITS | b, left)
                    break
                left -= n
        if not wanted:
            break
    return found


def quantiles(values: DataFrame, n: int, at: tuple[float, ...]) -> list[float | None]:
    """Quantiles of ``n`` doubles, interpolated between neighbours; nulls of an empty table."""
    import math

    if not n:
        return [None] * len(at)
    places = [q * (n - 1) for q in at]
    own = at_ranks(values, [r for x in places for r in (math.floor(x), math.ceil(x))])
    low, high = [own[math.floor(x)] for x in places], [own[math.ceil(x)] for x in places]
    return [a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b for x, a, b in zip(places, low, high, strict=True)]


def profile(df: DataFrame, value: Column, at: tuple[float, ...]) -> tuple:
    """n, lowest, highest, mean and the quantiles of a column; its values are stored once, as each pass reads them."""
    from siltstone import scratch

    values = scratch.stored(df.select(value.cast("double").alias("v")).filter("v is not null"), "ranked-values")
    row = values.agg(F.count("*").alias("n"), F.min("v"), F.max("v"), F.avg("v")).first()
    out = (*row, *quantiles(values, row["n"], at))
    scratch.forget(values)
    return out
