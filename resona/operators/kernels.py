"""Grouped NumPy kernels for what has no relational form: STFT, IIR filters, envelopes and peaks.

A group is one channel of one signal, which Spark deals out by key; longer records are split into chunks first
(signals.chunked_rms shows how). Records are the last axis of the arrays that most kernels take: a task hands them its records of one
length at a time, since short ones cost calls and not samples. All constants follow the public definitions of the filters and windows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.operators.peaks import find_peaks

KURTOGRAM = "signal_id long, channel string, level int, band int, f_lo double, f_hi double, kurtosis double, best boolean"
BAND = "signal_id long, channel string, f_lo double, f_hi double, reliable boolean"
#: Samples that a task hands a kernel at once, where a single record hasn't more.
AT_ONCE = 1 << 18
FAULT = "signal_id long, channel string, fault string, severity double, confidence double, n_harmonics int, sidebands boolean"


def hann(n: int, periodic: bool = False) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n if periodic else n - 1)) if n > 1 else np.ones(n)


def detrend(x: np.ndarray) -> np.ndarray:
    n, mean = x.shape[-1], x.mean(-1, keepdims=True) if x.shape[-1] else 0.0
    if n < 2:
        return x - mean
    t = np.arange(n) - (n - 1) / 2
    return x - mean - t * np.vecdot(x, t)[..., None] / (t @ t)


def stft(x: np.ndarray, size: int) -> np.ndarray:
    """Magnitudes (frame, bin) of half-overlapping Hann frames over the zero-extended signal."""
    hop = size // 2
    n = x.shape[-1] + 2 * hop
    zeros = lambda k: np.zeros((*x.shape[:-1], k))
    padded = np.concatenate([zeros(hop), x, zeros(hop), zeros(-(n - size) % hop if n > size else size - n)], axis=-1)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size, axis=-1)[..., ::hop, :]
    return np.abs(np.fft.rfft(frames * hann(size, True), axis=-1))


def kurtosis(x: np.ndarray) -> np.ndarray:
    """Excess kurtosis of a population; nan without variance."""
    c = x - x.mean(-1, keepdims=True)
    v = (c * c).mean(-1)
    square = np.reshape([s**2 for s in v.flat], v.shape)  # as scalars, which arrays round differently: bands of three frames differ by no more
    return np.where(v > 1e-300, (c**4).mean(-1) / np.where(v > 1e-300, square, 1.0) - 3, np.nan)[()]


def band_kurtoses(x: np.ndarray, fs: float, size: int = 1024, levels: int = 5, guard: float = 0.15) -> tuple[list[tuple[int, int, float, float]], np.ndarray]:
    """(level, band, f_lo, f_hi) of 2 ** level bands, and for each the kurtosis over frames of its magnitude; bands near Nyquist or under two bins are left out."""
    size = max(2, min(size, x.shape[-1] // 2 * 2))
    mags = stft(detrend(x), size)
    freqs, places, values, known = np.fft.rfftfreq(size, 1 / fs), [], [], {}
    for level in range(1, levels + 1):
        edges = np.linspace(0, len(freqs), 2**level + 1).astype(int).tolist()
        for band, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b - a >= 2 and freqs[b - 1] <= (1 - guard) * fs / 2:
                if (a, b) not in known:
                    known[a, b] = kurtosis(mags[..., a:b].sum(-1))
                places.append((level, band, float(freqs[a]), float(freqs[b - 1])))
                values.append(known[a, b])
    return places, np.stack(values, axis=-1) if values else np.zeros((*x.shape[:-1], 0))


def kurtogram(x: np.ndarray, fs: float, size: int = 1024) -> list[tuple[int, int, float, float, float]]:
    """(level, band, f_lo, f_hi, kurtosis) of a record's bands; those without variance are left out."""
    places, values = band_kurtoses(x, fs, size)
    return [(*place, k) for place, k in zip(places, values.tolist(), strict=True) if np.isfinite(k)]


def top_kurtosis(values: np.ndarray) -> np.ndarray:
    """The greatest finite value of each record's bands; without one, minus infinity."""
    return np.where(np.isfinite(values), values, -np.inf).max(-1, initial=-np.inf)


def reliable(x: np.ndarray, fs: float, seed: int, runs: int = 5, z: float = 3.0, size: int = 1024) -> np.ndarray:
    """Whether the kurtogram's maximum stands z deviations over those of shuffled signals; the seed makes retries agree, and shuffles records of one length alike."""
    random, places = np.random.RandomState(seed % (1 << 32)), np.arange(x.shape[-1])
    own = top_kurtosis(band_kurtoses(x, fs, size)[1])
    others = np.stack([top_kurtosis(band_kurtoses(x.take(random.permutation(places), -1), fs, size)[1]) for _ in range(runs)], axis=-1)
    known = np.isfinite(own) & np.isfinite(others).all(-1)
    own, others = np.where(known, own, 0.0), np.where(known[..., None], others, 0.0)
    spread, mean = others.std(-1), others.mean(-1)
    return (known & np.where(spread < 1e-9, own > mean, (own - mean) / np.where(spread < 1e-9, 1.0, spread) >= z))[()]


def best_bands(x: np.ndarray, fs: float, size: int = 1024, seed: int = 42) -> list[tuple[float | None, float | None, bool]]:
    """(f_lo, f_hi, whether it is reliable) of the band with the greatest kurtosis, the first of equals, for each of the records x (record, sample)."""
    places, values = band_kurtoses(x, fs, size)
    top = top_kurtosis(values)
    sure = reliable(x, fs, seed, size=size) if places else np.zeros(len(x), bool)
    at = np.where(np.isfinite(values), values, -np.inf).argmax(-1) if places else np.zeros(len(x), int)
    return [(*places[k][2:], bool(r)) if np.isfinite(t) else (None, None, False) for k, t, r in zip(at, top, sure, strict=True)]


def together(records: Iterable, key: Callable[..., Hashable], size: int = AT_ONCE) -> Iterator[tuple[list[int], np.ndarray]]:
    """The places of records of equal length and key, and the records as rows of one array; some `size` samples at a time."""
    records, groups = [np.asarray(r, float) for r in records], {}
    for k, r in enumerate(records):
        groups.setdefault((len(r), key(k)), []).append(k)
    for (n, _), places in groups.items():
        step = max(1, size // max(1, n))
        for lo in range(0, len(places), step):
            yield (some := places[lo : lo + step]), np.stack([records[k] for k in some])


@functools.lru_cache(1024)
def butter(order: int, cut: tuple[float, float] | float, fs: float) -> np.ndarray:
    """Second-order sections of a Butterworth band-pass (a pair of cuts) or high-pass (one cut)."""
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warp = lambda f: 4 * np.tan(np.pi * f / fs)
    if isinstance(cut, tuple):
        lo, hi = warp(cut[0]), warp(cut[1])
        half = poles * (hi - lo) / 2
        root = np.sqrt(half**2 - lo * hi)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), (hi - lo) ** order
    else:
        poles, zeros, gain = warp(cut) / poles, np.zeros(order), 1.0
    zp, zz = (4 + poles) / (4 - poles), (4 + zeros) / (4 - zeros)
    gain = float(np.real(gain * np.prod(4 - zeros) / np.prod(4 - poles)))
    zz = np.concatenate([zz, -np.ones(len(zp) - len(zz))])
    up = sorted((p for p in zp if p.imag > 0), key=lambda p: abs(1 - abs(p)), reverse=True)
    real = sorted(p.real for p in zp if abs(p.imag) < 1e-12)
    pairs = [(p, p.conj()) for p in up if abs(p.imag) >= 1e-12] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    zz = sorted(zz.real)
    sections = []
    for k, pair in enumerate(pairs):
        b = np.real(np.poly([zz[k], zz[-1 - k]])) if len(zz) >= 2 else np.array([1.0, -zz[0], 0.0])
        sections.append(np.concatenate([b, np.real(np.poly(pair))]))
    out = np.array(sections)
    out[0, :3] *= gain
    out.setflags(write=False)
    return out


def sosfilt(sections: np.ndarray, x: np.ndarray, steady: bool = False) -> np.ndarray:
    """Cascade of sections; steady: begin as if the first value had always been there.

    A section's response within a block is a matrix product; only its two states go from block to block.
    """
    y = np.asarray(x, float)
    n, many = y.shape[-1], y.shape[:-1]
    level = y[..., :1] if n else np.zeros((*many, 1))
    block = max(1, min(64, int(n**0.5)))
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    for b0, b1, b2, _, a1, a2 in sections:
        rest = level * (b0 + b1 + b2) / (1 + a1 + a2) if steady else 0.0 * level
        state = np.concatenate([rest - b0 * level, b2 * level - a2 * rest], axis=-1) if steady else np.zeros((*many, 2))
        step, gain = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = np.empty((block + 1, 2, 2))
        powers[0] = np.eye(2)
        for k in range(block):
            powers[k + 1] = step @ powers[k]
        response = np.concatenate([[b0], powers[: block - 1, 0] @ gain])
        rows = np.concatenate([y, np.zeros((*many, -n % block))], axis=-1).reshape(*many, -1, block)
        pushed = rows @ (powers[:block][::-1] @ gain)
        states = np.empty((*many, rows.shape[-2], 2))
        for k in range(rows.shape[-2]):
            states[..., k, :] = state
            state = np.matvec(powers[block], state) + pushed[..., k, :]
        out = rows @ np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0).T + states @ powers[:block, 0].T
        y, level = out.reshape(*many, -1)[..., :n], rest
    return y


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering over an odd extension."""
    pad = min(3 * (2 * len(sections) + 1), x.shape[-1] - 1)
    if pad < 1:
        return x
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1)
    forward = sosfilt(sections, ext, True)
    return sosfilt(sections, forward[..., ::-1], True)[..., ::-1][..., pad:-pad]


def band_pass(x: np.ndarray, fs: float, lo: float, hi: float, order: int = 4, guard: float = 0.02) -> np.ndarray:
    hi = min(hi, (1 - guard) * fs / 2)
    lo = max(lo, 1.0)
    if lo >= hi:
        lo = hi / 2
    return zero_phase(butter(order, (lo, hi), fs), x)


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[: n // 2 + 1] = 2
    gain[0] = 1
    if n % 2 == 0 and n:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def envelope_spectrum(env: np.ndarray, fs: float, cut: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided amplitudes of the detrended, high-passed, Hann-weighted envelope."""
    n = env.shape[-1]
    x = detrend(env)
    x = x - x.mean(-1, keepdims=True)
    if n > 12 and cut < fs / 2:
        x = zero_phase(butter(2, cut, fs), x)
    w = hann(n)
    mag = np.abs(np.fft.rfft(x * w)) / n / w.mean()
    mag[..., 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), mag


def envelope_spectra(records: Iterable, fs: list[float], lo: list[float], hi: list[float], least: int = 8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, frequencies and amplitudes of each record of `least` samples or more, detrended and filtered to its band."""
    for places, x in together(records, lambda k: (fs[k], lo[k], hi[k])):
        if x.shape[-1] >= least:
            k = places[0]
            freqs, mag = envelope_spectrum(envelope(band_pass(detrend(x), fs[k], lo[k], max(hi[k], lo[k] + 1))), fs[k])
            yield from ((at, freqs, m) for at, m in zip(places, mag, strict=True))


def simpson(y: np.ndarray, h: float) -> float:
    """Composite Simpson rule; an even number of points ends with the corrected last interval."""
    n = len(y)
    if n < 2:
        return 0.0
    if n == 2:
        return float(h * y.sum() / 2)
    if n % 2:
        return float(h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))
    return simpson(y[:-1], h) + float(h * (5 * y[-1] + 8 * y[-2] - y[-3]) / 12)


def band_energy(freqs: np.ndarray, mag: np.ndarray, at: float, half: float) -> float:
    inside = (freqs >= at - half) & (freqs <= at + half)
    if inside.sum() < 2:
        return float(mag[np.abs(freqs - at).argmin()])
    f = freqs[inside]
    return float(np.sqrt(max(0.0, simpson(mag[inside] ** 2, f[1] - f[0]) / (f[-1] - f[0]))))


def match(freqs: np.ndarray, mag: np.ndarray, faults: dict[str, float], fr: float, harmonics: int = 3) -> list[tuple[str, float, float, int, bool]]:
    """(fault, severity, confidence, harmonics matched, sidebands) of the fault frequencies in a spectrum."""
    if not len(mag):
        return []
    positive = mag[mag > 0]
    floor = float(np.median(positive)) if len(positive) else 0.0
    peaks = freqs[find_peaks(mag, max(0.05 * mag.max(), 1.5 * floor))]
    out = []
    for name, base in faults.items():
        severity, hits = 0.0, 0
        for h in range(1, harmonics + 1):
            target, limit = base * h, max(0.5, base * h * 0.015) * (1 + 0.1 * (h - 1))
            if target < freqs[-1] and len(peaks) and np.abs(peaks - target).min() <= limit:
                lo, hi = (0.5, max(3 * fr, 100.0)) if target <= 2.5 * fr else (target - max(5 * fr, 50.0), target + max(5 * fr, 50.0))
                near = mag[(freqs >= lo) & (freqs <= hi) & (mag > 0)]
                severity += band_energy(freqs, mag, target, limit) / (float(np.median(near)) if len(near) else floor or 1.0)
                hits += 1
        space = {"BPFI": fr, "BSF": faults.get("FTF", fr)}.get(name)
        sides = [base + o * space for o in (-2, -1, 1, 2)] if space else []
        side = any(0.5 <= s < freqs[-1] and len(peaks) and np.abs(peaks - s).min() <= max(0.5, s * 0.015) for s in sides)
        out.append((name, round(severity, 2), round(hits / harmonics, 2), hits, bool(side and hits)))
    return out


def orbit(x: np.ndarray, y: np.ndarray | None, fs: float, fr: float, most: int = 1200) -> tuple[np.ndarray, np.ndarray]:
    """Shaft orbit: causal band-pass around 0.4 to 3.5 times fr, quadrature where one probe is missing, six revolutions after the first two."""
    sections = butter(4, (0.4 * fr, min(3.5 * fr, 0.98 * fs / 2)), fs)
    a = sosfilt(sections, x)
    spectrum = np.fft.fft(a)
    turn = np.zeros(len(a))
    turn[1 : (len(a) + 1) // 2] = 2
    b = np.imag(np.fft.ifft(spectrum * turn)) if y is None else sosfilt(sections, y)
    lo, hi = int(2 * fs / fr), int(8 * fs / fr)
    step = max(1, -(-(min(hi, len(a)) - lo) // most))
    return a[lo:hi:step], b[lo:hi:step]


def dealt(signal: DataFrame) -> DataFrame:
    """Channels over all shuffle partitions: a kernel's work isn't told by its few bytes, so these aren't merged by size."""
    return signal.repartition(int(signal.sparkSession.conf.get("spark.sql.shuffle.partitions")), "signal_id", "channel")


def packed(signal: DataFrame, *more: str) -> DataFrame:
    """A row per channel with its samples in order as one array, and the first of the columns `more`."""
    xs = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return dealt(signal).groupBy("signal_id", "channel").agg(xs.alias("xs"), *(F.first(c).alias(c) for c in more))


def kurtograms(signal: DataFrame, fs: float, size: int = 1024) -> DataFrame:
    """The kurtogram of each channel; best marks the first greatest value (a level must exceed those before it)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            names = list(zip(pdf["signal_id"], pdf["channel"], strict=True))
            for places, x in together(pdf["xs"], lambda k: None):
                at, values = band_kurtoses(x, fs, size)
                for place, own in zip(places, values.tolist(), strict=True):
                    rows = [(*band, k) for band, k in zip(at, own, strict=True) if np.isfinite(k)]
                    best = max(range(len(rows)), key=lambda k: (rows[k][4], -k), default=-1)
                    out += [(*names[place], *r, k == best) for k, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["signal_id", "channel", "level", "band", "f_lo", "f_hi", "kurtosis", "best"])

    return packed(signal).mapInPandas(each, KURTOGRAM)


def bands(signal: DataFrame, fs: float, size: int = 1024, seed: int = 42) -> DataFrame:
    """The band of each channel's kurtogram with the greatest kurtosis, and whether it is reliable; no band, none in f_lo and f_hi."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = {}
            for places, x in together(pdf["xs"], lambda k: None):
                out |= zip(places, best_bands(x, fs, size, seed), strict=True)
            found = pd.DataFrame([out[k] for k in range(len(pdf))], columns=["f_lo", "f_hi", "reliable"])
            yield pd.concat([pdf[["signal_id", "channel"]].reset_index(drop=True), found], axis=1)

    return packed(signal).mapInPandas(each, BAND)


def envelope_faults(signal: DataFrame, fs: float, fr: float, size: int = 1024, fallback: DataFrame | None = None) -> DataFrame:
    """Fault matches in each channel's envelope spectrum, all channels of a signal filtered to one band.

    signal: signal_id, channel, i, x and a struct `frequencies` of fault frequencies. The band is the one that the primary
    channel's kurtogram chose, if that is reliable; else the signal's own of `fallback` (signal_id, band_lo, band_hi), such as
    the band of the speed's envelope filter. It is chosen once per signal and reaches the other channels as a column.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            lo, hi = pdf["f_lo"].fillna(max(500.0, 0.1 * fs)).tolist(), pdf["f_hi"].fillna(min(0.45 * fs, 5000.0)).tolist()
            keys, out = list(zip(pdf["signal_id"], pdf["channel"], pdf["frequencies"], strict=True)), []
            for k, *spectrum in envelope_spectra(pdf["xs"], [fs] * len(pdf), lo, hi):
                signal_id, channel, frequencies = keys[k]
                out += [(signal_id, channel, *f) for f in match(*spectrum, dict(frequencies), fr)]
            yield pd.DataFrame(out, columns=["signal_id", "channel", "fault", "severity", "confidence", "n_harmonics", "sidebands"])

    from resona.sources.signals import primary_channel

    chosen = bands(primary_channel(signal, "signal_id"), fs, size).where("reliable").select("signal_id", "f_lo", "f_hi")
    if fallback is not None:
        other = fallback.select("signal_id", "band_lo", "band_hi")
        chosen = other.join(chosen, "signal_id", "left").select("signal_id", F.coalesce("f_lo", "band_lo").alias("f_lo"), F.coalesce("f_hi", "band_hi").alias("f_hi"))
    return dealt(packed(signal, "frequencies").join(chosen, "signal_id", "left")).mapInPandas(each, FAULT)
