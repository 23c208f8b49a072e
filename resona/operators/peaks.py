"""Peaks and their prominence in linear time, from chunks of a record.

A record is a sequence of runs of equal samples; only its turning points matter. A peak is settled within a chunk if the
chunk holds a higher sample on both sides of it. What isn't settled (the rising and falling staircases towards the
chunk's highest sample, with the lowest point between two steps, and the chunk's ends) goes on as a shorter sequence of
the same kind, so neighbouring chunks are joined and settled again until one sequence is the whole record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.sources.held import held

ROWS = "signal_id long, channel string, chunk long, v array<double>, first array<long>, last array<long>, at array<long>, height array<double>, prominence array<double>"


def folded(v: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends and turning points of a sequence of runs; equal neighbours become one run."""
    if not len(v):
        return v, first, last
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    v, first, last = v[starts], first[starts], last[np.append(starts[1:] - 1, len(last) - 1)]
    up = v[1:] > v[:-1]
    keep = np.concatenate([[0], np.flatnonzero(up[1:] != up[:-1]) + 1, [len(v) - 1]]) if len(v) > 1 else np.array([0])
    return v[keep], first[keep], last[keep]


def settled(v: np.ndarray, whole: bool) -> tuple[list[int], list[float], np.ndarray]:
    """Of turning points, the places and prominences of the peaks that are settled, and the places that aren't.

    A monotone stack of heights: each entry has the lowest point since the entry below it, and since the last higher one.
    whole: beyond the ends there is nothing, so all peaks are settled; the ends themselves are none.
    """
    x, n = v.tolist(), len(v)
    stack: list[tuple[float, float, float, int]] = []
    at, prominence, open_ = [], [], []

    def take(q: tuple[float, float, float, int], low: float) -> None:
        if 0 < q[3] < n - 1 and (whole or (stack and stack[0][0] > q[0])):
            at.append(q[3])
            prominence.append(q[0] - max(q[2], low))
        else:
            open_.append(q[3])

    for k in range(1 if n > 1 and x[1] > x[0] else 0, n, 2):
        low = x[k - 1] if k else np.inf
        while stack and stack[-1][0] < x[k]:
            q = stack.pop()
            take(q, low)
            low = min(low, q[1])
        stack.append((x[k], low, min(low, stack[-1][2]) if stack and stack[-1][0] == x[k] else low, k))
    low = x[-1] if n else np.inf
    while stack:
        q = stack.pop()
        if whole:
            take(q, low)
        else:
            open_.append(q[3])
        low = min(low, q[1])
    if whole or not n:
        return at, prominence, np.zeros(0, int)
    ends = np.unique([0, n - 1, *open_])
    between = [a + 1 + int(v[a + 1 : b].argmin()) for a, b in zip(ends, ends[1:], strict=False) if b - a > 1]
    return at, prominence, np.unique(np.concatenate([ends, np.array(between, int)]))


def find_peaks(x: np.ndarray, least: float) -> np.ndarray:
    """Local maxima (the middle of a plateau) whose prominence is at least `least`."""
    i = np.arange(len(x))
    v, first, last = folded(np.asarray(x, float), i, i)
    at, prominence, _ = settled(v, True)
    where = np.array(at, int)[np.array(prominence) >= least] if at else np.zeros(0, int)
    return np.sort((first[where] + last[where]) // 2)


def _settle(points: Iterator[tuple], whole: bool) -> pa.RecordBatch:
    """points: signal_id, channel, chunk, v, first, last."""
    out: dict[str, list] = {name.split(" ")[0]: [] for name in ROWS.split(", ")}
    for signal_id, channel, chunk, v, first, last in points:
        v, first, last = folded(v, first, last)
        at, prominence, rest = settled(v, whole)
        middle = (first[at] + last[at]) // 2
        for name, value in zip(out, (signal_id, channel, chunk, v[rest], first[rest], last[rest], middle, v[at], np.array(prominence, float)), strict=True):
            out[name].append(value)
    kinds = {"signal_id": pa.int64(), "channel": pa.string(), "chunk": pa.int64(), "v": pa.list_(pa.float64()), "first": pa.list_(pa.int64()), "last": pa.list_(pa.int64()), "at": pa.list_(pa.int64()), "height": pa.list_(pa.float64()), "prominence": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in out], list(out))


def _joined(fan: int, whole: bool) -> Callable[[pa.Table], pa.Table]:
    """The chunks of a group, in order, as one."""

    def join(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        points = (np.concatenate([np.array(r[c]) for r in parts]) for c in ("v", "first", "last"))
        return pa.Table.from_batches([_settle([(parts[0]["signal_id"], parts[0]["channel"], parts[0]["chunk"] // fan, *points)], whole)])

    return join


def prominent_peaks(signal: DataFrame, size: int = 1 << 16, fan: int = 64) -> DataFrame:
    """signal_id, channel, i, x, prominence: every local maximum of each channel of (signal_id, channel, i, x), plateaus by their middle.

    prominence is the height over the higher of the two lowest points towards the next higher samples, or towards the record's
    ends. Records are cut into chunks of `size` samples, whatever their length, and joined by `fan`; the result doesn't depend on
    either. Samples that are null or NaN are left out, as if their neighbours met. A record of one value has no peak.
    """
    chunk = F.floor(F.col("i") / size)
    rows = signal.where("x is not null and not isnan(x)").groupBy("signal_id", "channel", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    cut = rows.select("signal_id", "channel", "chunk", F.col("s.x").alias("v"), F.col("s.i").alias("first"))
    n = (signal.agg(F.max(chunk)).first()[0] or 0) + 1

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _settle(((r["signal_id"], r["channel"], r["chunk"], np.array(r["v"], float), i := np.array(r["first"], np.int64), i) for r in batch.to_pylist()), n == 1)

    found = cut.mapInArrow(first_level, ROWS)
    levels = [found if n == 1 else held(found, "peaks")]
    while n > 1:
        n = -(-n // fan)

        joined = levels[-1].select("signal_id", "channel", "chunk", "v", "first", "last").groupBy("signal_id", "channel", F.floor(F.col("chunk") / fan)).applyInArrow(_joined(fan, n == 1), ROWS)
        levels.append(joined if n == 1 else held(joined, "peaks"))
    each = [level.select("signal_id", "channel", F.inline(F.arrays_zip(F.col("at").alias("i"), F.col("height").alias("x"), "prominence"))) for level in levels]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out.toDF("signal_id", "channel", "i", "x", "prominence")
