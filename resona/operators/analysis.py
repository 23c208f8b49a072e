"""The whole analysis of a signal: all branches over one written table of packed channels, one typed row for each signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.functions.records import machine_route
from resona.functions.signal import fault_frequencies, machine_class
from resona.operators import faults, kernels
from resona.operators.peaks import find_peaks
from resona.operators.signals import severity_zones
from resona.sources.held import held
from resona.sources.signals import primary_channel

MEASURES = (
    "signal_id long, n long, rms double, peak double, crest double, kurtosis double, baseline double, "
    "orders array<struct<order: double, amplitude: double>>, named array<struct<mechanism: string, target: double, found: double, amplitude: double, severity: double>>"
)


def order_amplitudes(freqs: np.ndarray, mag: np.ndarray, fr: float, harmonics: int = 5) -> tuple[float, list[tuple[float, float]]]:
    """Baseline, and the amplitude of the shaft's half order and its first harmonics; 0 where no peak stands two baselines out."""
    positive = mag[mag > 0]
    base = float(np.median(positive)) if len(positive) else 1.0
    peaks = freqs[find_peaks(mag, 2 * base)]
    out = []
    for order in (0.5, *range(1, harmonics + 1)):
        at, step = fr * order, max(1.0, order)
        limit = max(0.15, 0.03 * step) * (1 + 0.1 * (step - 1))
        if order < 1 or at < freqs[-1]:
            there = len(peaks) and np.abs(peaks - at).min() <= limit
            out.append((float(order), kernels.band_energy(freqs, mag, at, limit) if there else 0.0))
    return base, out


def named_lines(freqs: np.ndarray, mag: np.ndarray, targets: list[tuple[str, float]], allowed: float = 2.0) -> list[tuple]:
    """(mechanism, target, found, amplitude, severity) for single frequencies; a target that isn't below the last bin is null."""
    positive = mag[mag > 0]
    base = float(np.median(positive)) if len(positive) else 1.0
    peaks = find_peaks(mag, max(0.05 * mag.max(initial=0.0), 1.5 * base))
    out = []
    for name, at in targets:
        if at >= freqs[-1]:
            out.append((name, None, None, 0.0, 0.0))
            continue
        k = peaks[np.abs(freqs[peaks] - at).argmin()] if len(peaks) else None
        if k is None or abs(freqs[k] - at) > allowed:
            out.append((name, at, None, 0.0, 0.0))
            continue
        a, b, c = mag[k - 1], mag[k], mag[k + 1]
        bend = a - 2 * b + c
        shift = float(np.clip(0.5 * (a - c) / bend, -1, 1)) if bend else 0.0
        energy = kernels.band_energy(freqs, mag, at, allowed)
        out.append((name, at, float(freqs[k] + shift * (freqs[1] - freqs[0])), energy, energy / base))
    return out


def _measures(least: int):
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                x = kernels.detrend(np.asarray(row.xs, float))
                n, rms, peak = len(x), float(np.sqrt((x * x).mean())), float(np.abs(x).max())
                kurtosis = kernels.kurtosis(x) if n >= least else float("nan")
                stats = (row.signal_id, n, rms, peak, peak / (rms + 1e-9), kurtosis if np.isfinite(kurtosis) else None)
                if n < least:
                    out.append((*stats, None, None, None))
                    continue
                freqs, mag = np.fft.rfftfreq(n, 1 / row.fs), np.abs(np.fft.rfft(x * kernels.hann(n)))
                base, orders = order_amplitudes(freqs, mag, row.rpm / 60)
                targets = [(t["mechanism"], t["hz"]) for t in row.targets] if row.targets is not None else None
                out.append((*stats, base, orders if targets is None else None, None if targets is None else named_lines(freqs, mag, targets)))
            yield pd.DataFrame(out, columns=["signal_id", "n", "rms", "peak", "crest", "kurtosis", "baseline", "orders", "named"])

    return each


def _envelopes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        keys = list(zip(pdf["signal_id"], pdf["channel"], pdf["frequencies"], pdf["rpm"], strict=True))
        for k, *spectrum in kernels.envelope_spectra(pdf["xs"], *(pdf[c].tolist() for c in ("fs", "band_lo", "band_hi"))):
            signal, channel, frequencies, rpm = keys[k]
            lines = {k: v for k, v in frequencies.items() if k in ("BPFO", "BPFI", "BSF", "FTF")}
            out += [(signal, channel, *f) for f in kernels.match(*spectrum, lines, rpm / 60)]
        yield pd.DataFrame(out, columns=["signal_id", "channel", "fault", "severity", "confidence", "n_harmonics", "sidebands"])


def _listed(rows: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """One array of structs for each signal, in the structs' own order."""
    return rows.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def signal_analysis(signal: DataFrame, machines: DataFrame, zones: DataFrame, filters: DataFrame, table: DataFrame, mechanisms: DataFrame, patterns: DataFrame, least: int = 8) -> DataFrame:
    """A row for each signal of (signal_id, channel, i, x) that machines knows.

    machines: signal_id, fs, rpm, kind, class, velocity_rms (null: that of the signal), n_balls, ball, pitch, angle, cylinders, strokes.
    Result: signal_id, machine (rotating or reciprocating), primary_channel (main, DE, FE, BA, else the first by name), stats, severity,
    band (lo, hi, source, reliable), envelope (faults of each channel), localisation, direct (ratio faults), observed_order, matches
    (patterns of that order), reciprocating (mechanisms) and primary (the best candidate).

    Samples are packed once and written; every branch reads that table. All channels of a rotating machine are filtered to one
    band: that of the primary channel's kurtogram if it is reliable, else that of the envelope filter of the speed. Reciprocating
    machines have their mechanisms matched instead. Primary records of under `least` samples have statistics only, and other
    channels of under 8 no envelope; what a machine has no data for (no class, impossible geometry) is null.
    """
    known = machines.withColumns({"machine": machine_route(F.col("kind")), "fr": F.col("rpm") / 60, "frequencies": fault_frequencies(F.col("rpm"), F.col("n_balls"), F.col("ball"), F.col("pitch"), F.col("angle"))})
    engines = known.where("machine = 'reciprocating'").select(F.col("signal_id").alias("machine_id"), "rpm", "cylinders", "strokes")
    lines = faults.reciprocating_frequencies(engines, table).join(F.broadcast(mechanisms), "row_no").where("at_multiple is null or at_multiple = multiple")  # eight rows
    targets = lines.groupBy(F.col("machine_id").alias("signal_id")).agg(F.collect_list(F.struct("mechanism", "hz")).alias("targets"))
    packed = held(kernels.packed(signal), "channels")
    primary = primary_channel(packed.select("signal_id", "channel"), "signal_id").select("signal_id", F.col("channel").alias("primary_channel"))
    facts = held(known.join(primary, "signal_id").join(targets, "signal_id", "left"), "machines")
    main = packed.join(facts, (packed["signal_id"] == facts["signal_id"]) & (packed["channel"] == facts["primary_channel"])).drop(facts["signal_id"])

    measured = held(kernels.dealt(main.select("signal_id", "channel", "xs", "fs", "rpm", "targets")).mapInPandas(_measures(least), MEASURES), "measures")
    chosen = kernels.dealt(main.where("machine = 'rotating'").select("signal_id", "channel", "xs", "fs")).mapInPandas(_bands, "signal_id long, f_lo double, f_hi double, reliable boolean")
    speed = faults.band_filter(facts.where("machine = 'rotating'").select(F.col("signal_id").alias("machine_id"), "rpm"), filters).select(F.col("machine_id").alias("signal_id"), "filter_no", "band_lo", "band_hi")
    own = F.coalesce(F.col("reliable"), F.lit(False))
    band = held(
        chosen.join(speed, "signal_id", "left").select("signal_id", own.alias("reliable"), F.when(own, F.col("f_lo")).otherwise(F.col("band_lo")).alias("band_lo"), F.when(own, F.col("f_hi")).otherwise(F.col("band_hi")).alias("band_hi"), F.when(own, "kurtogram").otherwise(F.concat(F.lit("filter "), "filter_no")).alias("source")),
        "bands",
    )
    rotating = packed.join(facts.where("frequencies is not null").select("signal_id", "fs", "rpm", "frequencies"), "signal_id").join(band.where("band_lo is not null"), "signal_id")
    envelope = held(kernels.dealt(rotating).mapInPandas(_envelopes, kernels.FAULT), "envelopes")

    orders = measured.select("signal_id", "baseline", F.inline("orders"))
    direct = faults.ratio_patterns(orders).join(facts.where("machine = 'rotating'").select("signal_id"), "signal_id", "left_semi")
    observed = faults.dominant_order(orders)
    candidates = direct.where("confidence > 0").select("signal_id", F.lit("direct").alias("category"), F.upper("fault").alias("code"), F.lit(None).cast("string").alias("channel"), F.round("confidence", 2).alias("confidence"), F.round("severity", 2).alias("severity"), F.lit(0).alias("n_harmonics"), F.lit(False).alias("sidebands"), F.concat(F.lit("1"), "fault").alias("ordinal"))
    candidates = candidates.unionByName(envelope.select("signal_id", F.lit("envelope").alias("category"), F.col("fault").alias("code"), "channel", "confidence", "severity", "n_harmonics", "sidebands", F.concat_ws(" ", F.lit("2"), "channel", "fault").alias("ordinal")))
    engine = measured.select("signal_id", F.inline("named"))
    candidates = candidates.unionByName(engine.select("signal_id", F.lit("reciprocating").alias("category"), F.upper("mechanism").alias("code"), F.lit(None).cast("string").alias("channel"), F.lit(0.0).alias("confidence"), F.round("severity", 2).alias("severity"), F.lit(0).alias("n_harmonics"), F.lit(False).alias("sidebands"), F.concat(F.lit("3"), "mechanism").alias("ordinal")))
    best = faults.rank_faults(candidates).where("rank = 1").select("signal_id", F.struct("category", "code", "channel", "confidence", "severity", "score", "strong").alias("primary"))

    velocity = measured.join(facts, "signal_id").select("signal_id", F.coalesce("velocity_rms", "rms").alias("rms"), machine_class(F.col("class")).alias("class"))
    graded = severity_zones(velocity, zones).select("signal_id", F.struct("class", "rms", "zone", "meaning").alias("severity"))
    stats = measured.select("signal_id", F.struct("n", "rms", "peak", "crest", "kurtosis").alias("stats"))
    parts = [
        stats, graded, band.select("signal_id", F.struct(F.col("band_lo").alias("lo"), F.col("band_hi").alias("hi"), "source", "reliable").alias("band")),
        _listed(envelope, "envelope", "channel", "fault", "severity", "confidence", "n_harmonics", "sidebands"),
        _listed(faults.localise(envelope), "localisation", "fault", "verdict", "dominant_channel", "ratio"),
        _listed(direct, "direct", "fault", "severity", "confidence"), observed,
        _listed(faults.cross_check(observed, patterns), "matches", "pattern_no", "fault", "direction"),
        _listed(engine.select("signal_id", "mechanism", F.col("found").isNotNull().alias("matched"), "target", "found", "amplitude", "severity"), "reciprocating", "mechanism", "matched", "target", "found", "amplitude", "severity"),
        best,
    ]
    out = facts.select("signal_id", "machine", "primary_channel")
    for part in parts:
        out = out.join(part, "signal_id", "left")
    return out


def _bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        fs, out = pdf["fs"].tolist(), []
        for places, x in kernels.together(pdf["xs"], fs.__getitem__):
            found = kernels.best_bands(kernels.detrend(x), fs[places[0]])
            out += [(pdf["signal_id"].iat[k], *f) for k, f in zip(places, found, strict=True)]
        yield pd.DataFrame(out, columns=["signal_id", "f_lo", "f_hi", "reliable"])
