"""Peaks settled chunk by chunk, and framed spectra, against their definitions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resona.operators import kernels, peaks, spectra


def brute(x):
    """(middle, height, prominence) of all peaks, straight from the definition."""
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            a, b = i, j
            while a > 0 and x[a - 1] <= x[i]:
                a -= 1
            while b < len(x) - 1 and x[b + 1] <= x[i]:
                b += 1
            out.append(((i + j) // 2, x[i], x[i] - max(min(x[a : i + 1]), min(x[i : b + 1]))))
        i = j + 1
    return out


def chunked(x, size, fan):
    """As prominent_peaks does it, without Spark."""
    out, parts = [], []
    for lo in range(0, len(x), size):
        v = np.array(x[lo : lo + size], float)
        parts.append((v, np.arange(lo, lo + len(v)), np.arange(lo, lo + len(v))))
    while True:
        whole, rest = len(parts) == 1, []
        for v, first, last in (peaks.folded(*p) for p in parts):
            at, prominence, left = peaks.settled(v, whole)
            out += [(int(first[k] + last[k]) // 2, v[k], p) for k, p in zip(at, prominence, strict=True)]
            rest.append((v[left], first[left], last[left]))
        if whole:
            return sorted(out)
        parts = [tuple(np.concatenate([p[c] for p in rest[k : k + fan]]) for c in range(3)) for k in range(0, len(rest), fan)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 9), st.integers(2, 4))
def test_peaks_at_any_chunk_size(x, size, fan):
    assert chunked(x, size, fan) == brute(x)
    assert peaks.find_peaks(np.array(x), 2).tolist() == [i for i, _, p in brute(x) if p >= 2]


def test_work_is_linear():
    import time

    x = np.random.default_rng(1).normal(size=400_000)
    began = time.perf_counter()
    got = peaks.find_peaks(x, 3.0)
    assert len(got) and time.perf_counter() - began < 5
    ramp = np.arange(400_000.0) + np.tile([0.0, 3.0], 200_000)  # every peak is higher than those before
    assert len(peaks.find_peaks(ramp, 1.0)) == 199_999
    assert peaks.find_peaks is kernels.find_peaks


def test_prominent_peaks(spark):
    rng = np.random.default_rng(3)
    records = {(1, "a"): rng.integers(0, 9, 300).astype(float), (1, "b"): np.round(np.sin(np.arange(257) / 9), 1), (2, "a"): np.zeros(40), (3, "a"): np.array([1.0])}
    rows = [(s, c, i, float(v)) for (s, c), x in records.items() for i, v in enumerate(x)] + [(3, "a", 1, None), (3, "a", 2, float("nan"))]
    signal = spark.createDataFrame(rows, "signal_id long, channel string, i long, x double").repartition(5)
    want = sorted((s, c, *p) for (s, c), x in records.items() for p in brute(x.tolist()))
    for size, fan in ((1 << 16, 64), (16, 3), (7, 64)):
        assert sorted(tuple(r) for r in peaks.prominent_peaks(signal, size, fan).collect()) == want
    assert peaks.prominent_peaks(signal.where("false")).collect() == []


def test_spectrum_of_whole_records_and_of_frames(spark):
    rng = np.random.default_rng(4)
    records = {(1, "a"): rng.normal(size=37), (1, "b"): rng.normal(size=64), (2, "a"): rng.normal(size=150), (3, "a"): np.array([2.0])}
    signal = spark.createDataFrame([(s, c, i, float(v)) for (s, c), x in records.items() for i, v in enumerate(x)], "signal_id long, channel string, i long, x double").repartition(3)
    got = {}
    for r in spectra.spectrum(signal, 64).collect():
        got.setdefault((r.signal_id, r.channel), {})[r.bin] = (r.n, r.mag, r.frac)
    for key, x in records.items():
        parts = [x] if len(x) <= 64 else [x[:64], x[32:96], x[64:128], x[86:150]]
        power = np.mean([np.abs(np.fft.rfft(p * kernels.hann(len(p)))) ** 2 for p in parts], axis=0)
        assert [got[key][k][1] for k in range(len(power))] == pytest.approx(np.sqrt(power))
        assert {v[0] for v in got[key].values()} == {min(64, len(x))}
    held = {(r.signal_id, r.channel, r.frame): list(r.xs) for r in spectra.frames(signal, 64).collect()}
    assert held[2, "a", 3] == records[2, "a"][86:].tolist()


@pytest.mark.parametrize("m", range(2, 12))
def test_simpson_weights(spark, m):
    y = np.random.default_rng(m).normal(size=m)
    rows = spark.createDataFrame([(k, m, float(v)) for k, v in enumerate(y)], "k long, m long, y double")
    assert rows.agg(F.sum(spectra.simpson(F.col("k"), F.col("m")) * F.col("y"))).first()[0] == pytest.approx(kernels.simpson(y, 1.0))
