"""Closed forms of the signal kernels."""

from __future__ import annotations

import numpy as np
import pytest

from resona.operators import kernels as k

FS = 12_000.0
T = np.arange(12_000) / FS


def test_windows_and_detrend():
    assert k.hann(5).tolist() == pytest.approx([0, 0.5, 1, 0.5, 0])
    assert k.hann(4, True).tolist() == pytest.approx([0, 0.5, 1, 0.5])
    assert np.abs(k.detrend(3 + 2 * np.arange(50.0))).max() < 1e-9


def test_kurtosis():
    assert k.kurtosis(np.sin(2 * np.pi * 30 * T)) == pytest.approx(-1.5, abs=1e-3)
    assert np.isnan(k.kurtosis(np.ones(8)))


@pytest.mark.parametrize(("cut", "inside", "outside"), [((1000.0, 2000.0), 1414.2, 300.0), (200.0, 2000.0, 20.0)])
def test_filters_pass_and_stop(cut, inside, outside):
    sos = k.butter(4 if isinstance(cut, tuple) else 2, cut, FS)

    def gain(f):
        z = np.exp(-2j * np.pi * f / FS)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos]))

    assert gain(inside) == pytest.approx(1, abs=0.02)
    assert gain(outside) < 0.02
    for edge in cut if isinstance(cut, tuple) else (cut,):
        assert gain(edge) == pytest.approx(2**-0.5, abs=1e-3)


def test_zero_phase_keeps_place():
    x = np.sin(2 * np.pi * 1414.2 * T)
    y = k.band_pass(x, FS, 1000, 2000)
    assert np.abs(y - x)[500:-500].max() < 0.05


def test_envelope_of_modulated_tone():
    env = k.envelope((1 + 0.5 * np.sin(2 * np.pi * 100 * T)) * np.sin(2 * np.pi * 3000 * T))
    assert np.abs(env - (1 + 0.5 * np.sin(2 * np.pi * 100 * T)))[100:-100].max() < 1e-6


def test_peaks_and_simpson():
    x = np.array([0, 2, 1, 3, 3, 3, 0, 1, 0.0])
    assert k.find_peaks(x, 0.5).tolist() == [1, 4, 7]
    assert k.find_peaks(x, 1.5).tolist() == [4]
    grid = np.linspace(0, 1, 11)
    assert k.simpson(grid**3, 0.1) == pytest.approx(0.25)
    assert k.simpson(grid[:-1] ** 2, 0.1) == pytest.approx(0.9**3 / 3)


def test_bearing_fault_is_found():
    rng = np.random.default_rng(42)
    x = (1 + 0.8 * np.sin(2 * np.pi * 107.4 * T)) * np.sin(2 * np.pi * 3000 * T) + 0.05 * rng.normal(size=len(T))
    f, m = k.envelope_spectrum(k.envelope(k.band_pass(x, FS, 2500, 3500)), FS)
    found = {r[0]: r for r in k.match(f, m, {"BPFO": 107.4, "BPFI": 162.2, "FTF": 11.9}, 29.95)}
    assert found["BPFO"][3] >= 1 and found["BPFO"][1] > found["BPFI"][1]
    best = max(k.kurtogram(x, FS), key=lambda r: r[4])
    assert best[2] < best[3] <= 0.85 * FS / 2


def test_noise_is_not_reliable():
    x = np.random.default_rng(1).normal(size=8192)
    assert k.reliable(x, FS, 7) == k.reliable(x, FS, 7)


def test_orbit():
    x = np.sin(2 * np.pi * 30 * T)
    a, b = k.orbit(x, None, FS, 30.0)
    assert len(a) == len(b) <= 1200
    assert np.abs(np.hypot(a, b) - np.hypot(a, b).mean()).max() < 0.3


@pytest.mark.parametrize("n", [1, 3, 50, 1000, 4097])
@pytest.mark.parametrize("steady", [False, True])
def test_filter_is_the_recurrence(n, steady):
    x, sections = np.random.default_rng(n).normal(size=n), k.butter(4, (900.0, 2000.0), FS)
    want, level = x.tolist(), float(x[0])
    for b0, b1, b2, _, a1, a2 in sections:
        rest = level * (b0 + b1 + b2) / (1 + a1 + a2) if steady else 0.0
        past, out = [level if steady else 0.0] * 2 + want, [rest, rest]
        for i in range(n):
            out.append(b0 * past[i + 2] + b1 * past[i + 1] + b2 * past[i] - a1 * out[-1] - a2 * out[-2])
        want, level = out[2:], rest
    assert np.abs(k.sosfilt(sections, x, steady) - want).max() < 1e-9


def test_unreliable_bands_give_way(spark):
    """Three channels of which the impulsive one is reliable; faults are those of the band that each signal should have."""
    rng = np.random.default_rng(5)
    knock = 0.1 * rng.normal(size=4096)
    knock[1000:1100] += 3 * np.sin(2 * np.pi * 2500 * T[:100])
    signals = {1: knock, 2: rng.normal(size=4096), 3: rng.normal(size=4)}
    rows = [(s, "a", i, float(v)) for s, x in signals.items() for i, v in enumerate(x)]
    signal = spark.createDataFrame(rows, "signal_id long, channel string, i long, x double").repartition(3)
    got = {r.signal_id: r for r in k.bands(signal, FS).collect()}
    own = {s: k.reliable(x, FS, 42) for s, x in signals.items()}
    assert own[1] and not own[2] and {s: r.reliable for s, r in got.items()} == own
    named = {"BPFO": 107.4, "BPFI": 162.2}
    from pyspark.sql import functions as F

    other = spark.createDataFrame([(s, 500.0, 4000.0) for s in signals], "signal_id long, band_lo double, band_hi double")
    found = k.envelope_faults(signal.withColumn("frequencies", F.expr("named_struct('BPFO', 107.4D, 'BPFI', 162.2D)")), FS, 30.0, fallback=other).collect()
    want = []
    for s, x in list(signals.items())[:2]:
        lo, hi = (got[s].f_lo, got[s].f_hi) if own[s] else (500.0, 4000.0)
        spectrum = k.envelope_spectrum(k.envelope(k.band_pass(k.detrend(x), FS, lo, max(hi, lo + 1))), FS)
        want += [(s, *f) for f in k.match(*spectrum, named, 30.0)]
    assert sorted((r.signal_id, r.fault, r.severity, r.confidence, r.n_harmonics, r.sidebands) for r in found) == sorted(want)
