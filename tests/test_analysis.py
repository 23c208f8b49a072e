"""The whole analysis of signals against its kernels, called one by one."""

from __future__ import annotations

import numpy as np
import pytest

from resona import catalogue, schemas
from resona.operators import analysis, kernels

FS, RPM = 12_000.0, 1797.0
T = np.arange(8192) / FS
MACHINES = "signal_id long, fs double, rpm double, kind string, class string, velocity_rms double, n_balls int, ball double, pitch double, angle double, cylinders int, strokes int"


def machine(i, kind, cls, rms=None, n=9):
    return (i, FS, RPM, kind, cls, rms, n, 0.3126, 1.537, 0.0, 6, 4)


@pytest.fixture(scope="module")
def records():
    rng = np.random.default_rng(7)
    noise = lambda: 0.05 * rng.normal(size=len(T))
    outer = 1 + 0.9 * np.sin(2 * np.pi * 107.36 * T)
    return {
        (1, "FE"): 0.1 * outer * np.sin(2 * np.pi * 3000 * T) + noise(),
        (1, "DE"): outer * np.sin(2 * np.pi * 3000 * T) + noise() + 2 * np.sin(2 * np.pi * RPM / 60 * T),
        (2, "b"): np.sin(2 * np.pi * 2 * RPM / 60 * T) + noise(),
        (2, "a"): np.sin(2 * np.pi * 2 * RPM / 60 * T) + noise(),
        (3, "main"): np.array([1.0, 2.0, 1.5]),
        (4, "main"): noise(),
    }


@pytest.fixture(scope="module")
def found(spark, records):
    signal = spark.createDataFrame([(s, c, i, float(v)) for (s, c), x in records.items() for i, v in enumerate(x)], "signal_id long, channel string, i long, x double").repartition(3)
    machines = spark.createDataFrame([machine(1, "motor", "class_2", 3.0), machine(2, "reciprocating", "II"), machine(3, None, "none"), machine(4, "fan", "3", n=1), machine(5, "no signal", "1")], MACHINES)
    dims = (schemas.severity(spark), schemas.filters(spark), schemas.reciprocating(spark), schemas.mechanisms(spark), schemas.patterns(spark))
    return {r.signal_id: r for r in analysis.signal_analysis(signal, machines, *dims).collect()}


def test_signals_and_their_machines(found, records):
    assert sorted(found) == [1, 2, 3, 4]
    assert [found[i].primary_channel for i in (1, 2, 3)] == ["DE", "a", "main"]
    assert [found[i].machine for i in (1, 2, 3)] == ["rotating", "reciprocating", "rotating"]
    assert (found[1].severity.zone, found[1].severity["class"], found[1].severity.rms) == ("C", "Class II", 3.0) and found[3].severity is None
    x = kernels.detrend(records[1, "DE"])
    assert found[1].stats.rms == pytest.approx(np.sqrt((x * x).mean())) and found[1].stats.kurtosis == pytest.approx(kernels.kurtosis(x))


def test_envelope_in_the_band_of_the_primary_channel(found, records):
    r = found[1]
    own = kernels.reliable(kernels.detrend(records[1, "DE"]), FS, 42)
    best = max(kernels.kurtogram(kernels.detrend(records[1, "DE"]), FS), key=lambda k: k[4])
    assert (r.band.reliable, r.band.lo, r.band.hi, r.band.source) == ((True, *best[2:4], "kurtogram") if own else (False, 500.0, 10_000.0, "filter 3"))
    lines = {"BPFO": 107.3648, "BPFI": 162.1852, "BSF": 70.583, "FTF": 11.9294}
    for channel in ("DE", "FE"):
        x = kernels.detrend(records[1, channel])
        spectrum = kernels.envelope_spectrum(kernels.envelope(kernels.band_pass(x, FS, r.band.lo, r.band.hi)), FS)
        want = {f: (n, sides) for f, _, _, n, sides in kernels.match(*spectrum, lines, RPM / 60)}
        assert {e.fault: (e.n_harmonics, e.sidebands) for e in r.envelope if e.channel == channel} == want
    assert {p.fault for p in r.localisation} == set(lines)
    assert found[4].envelope is None and found[2].envelope is None and found[2].band is None


def test_direct_spectrum_and_engine(found, records):
    x = kernels.detrend(records[1, "DE"])
    f, mag = np.fft.rfftfreq(len(x), 1 / FS), np.abs(np.fft.rfft(x * kernels.hann(len(x))))
    base, orders = analysis.order_amplitudes(f, mag, RPM / 60)
    by = {d.fault: d for d in found[1].direct}
    a = dict(orders)
    assert by["unbalance"].severity == pytest.approx(a[1] / base if a[1] else 0) and found[1].observed_order == max((v, -k) for k, v in orders if k >= 1)[1] * -1
    assert found[2].direct is None and found[3].stats.n == 3 and found[3].direct is None
    hit = {m.mechanism for m in found[2].reciprocating if m.matched}
    assert {"inertia_2x", "piston_slap", "worn_connecting_rod_bearings", "unbalance_inertia_forces"} <= hit and "misfiring_piston" not in hit
    assert found[2].primary.category == "reciprocating" and not found[2].primary.strong
    assert found[1].primary.category in ("envelope", "direct")


def test_samples_are_read_once(spark, sf_dir):
    plan = catalogue.QUERIES["signal_analysis"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "value#" not in plan  # of events; branches read the packed table, and of it only what they need
    assert "xs#" not in plan
