"""Magnitude spectra by frames: overlapping runs of samples as rows, a Fourier transform for each, powers averaged by bin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["signal_id", "channel"]
FRAME = 1 << 20


def frames(signal: DataFrame, size: int = FRAME) -> DataFrame:
    """signal_id, channel, frame, xs: each record's samples in frames of `size` that overlap by half.

    A record of at most `size` samples is one frame. The last frame of a longer one ends with the record, so that every sample
    counts. A sample goes to the two or three frames that hold it; a row is one frame, so no task holds a channel.
    """
    hop = max(1, size // 2)
    n = signal.groupBy(*KEY).agg(F.count("*").alias("n"))
    full = F.greatest(F.lit(0), F.floor((F.col("n") - size) / hop))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / hop))
    inside = F.when(first <= F.least(full, F.floor(F.col("i") / hop)), F.sequence(first, F.least(full, F.floor(F.col("i") / hop)))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when((F.col("n") > size) & ((F.col("n") - size) % hop != 0) & (F.col("i") >= F.col("n") - size), F.array(full + 1)).otherwise(F.array().cast("array<bigint>"))
    each = signal.join(n, KEY).select(*KEY, "i", "x", F.explode(F.concat(inside, rest)).alias("frame"))
    return each.groupBy(*KEY, "frame").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(*KEY, "frame", F.col("s.x").alias("xs"))


def spectrum(signal: DataFrame, size: int = FRAME) -> DataFrame:
    """signal_id, channel, bin, n, mag, frac: Hann-weighted magnitudes of (signal_id, channel, i, x), i counting from 0 without gaps.

    Records of at most `size` samples have the spectrum of the whole record (n is their length). Of longer ones n is `size` and
    mag the root of the mean power of their frames: less fine, and steadier. frac is the frequency as a share of the sampling rate.
    """
    from resona.operators.kernels import hann

    def powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, np.ndarray]] = []
            weight = 0
            for row, xs in enumerate(batch.column(2)):
                x = xs.values.to_numpy(zero_copy_only=False)
                held.append((row, len(x), np.abs(np.fft.rfft(x * hann(len(x)))) ** 2))
                weight += len(x)
                if weight >= 1 << 19 or row == len(batch) - 1:
                    size_ = [len(p) for _, _, p in held]
                    at = pa.array(np.repeat([r for r, _, _ in held], size_))
                    bins = np.concatenate([np.arange(k) for k in size_])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(bins.astype(np.int64)), pa.array(np.repeat([n for _, n, _ in held], size_).astype(np.int64)), pa.array(np.concatenate([p for _, _, p in held]))], ["signal_id", "channel", "bin", "n", "power"])
                    held, weight = [], 0

    each = frames(signal, size).select(*KEY, "xs").mapInArrow(powers, "signal_id long, channel string, bin long, n long, power double")
    mean = each.groupBy(*KEY, "bin").agg(F.first("n").alias("n"), F.sqrt(F.avg("power")).alias("mag"))
    return mean.withColumn("frac", F.col("bin") / F.col("n"))


def simpson(k: Column, m: Column) -> Column:
    """Weight, in steps, of the k-th (from 0) of m equally spaced values; with an even m the last interval has its own three weights."""
    odd = m - (m + 1) % 2  # of the part with an odd number of values
    inner = F.when(k >= odd, 0.0).when((k == 0) | (k == odd - 1), 1 / 3).when(k % 2 == 1, 4 / 3).otherwise(2 / 3)
    last = F.when(m % 2 == 1, 0.0).when(k == m - 1, 5 / 12).when(k == m - 2, 8 / 12).when(k == m - 3, -1 / 12).otherwise(0.0)
    return F.when(m == 1, 0.0).when(m == 2, 0.5).otherwise(inner + last)


def band_rms(spectra: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """signal_id, channel, band_rms: root of the mean of mag**2 over [lo, hi] by Simpson's rule, frequencies as in column f.

    Where the band holds fewer than two bins it is the magnitude of the bin nearest to its middle (ties: the lower).
    """
    inside = spectra.withColumns({"lo": lo, "hi": hi}).where("f >= lo and f <= hi")
    whole = Window.partitionBy(*KEY)
    placed = inside.withColumns({"k": F.col("bin") - F.min("bin").over(whole), "m": F.count("*").over(whole)})
    weight = simpson(F.col("k"), F.col("m"))
    banded = placed.groupBy(*KEY).agg(F.sum(weight * F.col("mag") * F.col("mag")).alias("area"), F.first("m").alias("m"))
    middle = spectra.withColumn("gap", F.abs(F.col("f") - (lo + hi) / 2)).groupBy(*KEY).agg(F.min_by("mag", F.struct("gap", "f")).alias("nearest"))
    mean = F.sqrt(F.greatest(F.lit(0.0), F.col("area") / (F.col("m") - 1)))
    return middle.join(banded, KEY, "left").select(*KEY, F.when(F.col("m") > 1, mean).otherwise(F.col("nearest")).alias("band_rms"))
