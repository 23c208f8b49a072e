"""Vibration signals in long form (signal_id, channel, i, x): statistics, spectra, peaks and matches as Catalyst plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from resona.functions.signal import phase_gap, tolerance

KEY = ["signal_id", "channel"]


def by_time() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("i")


def whole() -> WindowSpec:
    return Window.partitionBy(*KEY)


def samples(events: DataFrame) -> DataFrame:
    """A signal per user and event type, numbered in time order."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("signal_id"), F.col("event_type").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("value").alias("x"))


def time_statistics(signal: DataFrame) -> DataFrame:
    """n, rms, peak, crest factor and excess kurtosis per channel; needs no order, so partial aggregation does it."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    return signal.groupBy(*KEY).agg(F.count("*").alias("n"), rms.alias("rms"), F.max(F.abs("x")).alias("peak"), (F.max(F.abs("x")) / (rms + 1e-9)).alias("crest"), F.kurtosis("x").alias("kurtosis"))


def severity_zones(graded: DataFrame, zones: DataFrame) -> DataFrame:
    """Interval join of (class, rms) with the zones; the 16-row dimension is broadcast."""
    inside = (graded["class"] == zones["class"]) & (graded["rms"] >= zones["lo"]) & (zones["hi"].isNull() | (graded["rms"] < zones["hi"]))
    return graded.join(F.broadcast(zones), inside).drop(zones["class"]).drop("lo", "hi")


def detrend(signal: DataFrame) -> DataFrame:
    """x less its least-squares line over i."""
    line = signal.groupBy(*KEY).agg(F.coalesce(F.regr_slope("x", "i"), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("x", "i"), F.first("x")).alias("start"))
    return signal.join(line, KEY).withColumn("x", F.col("x") - F.col("slope") * F.col("i") - F.col("start")).drop("slope", "start")


def validate(signal: DataFrame, fs: Column, least: float = 1000.0, expected: float | None = None) -> DataFrame:
    """n and why a channel can't be used: empty, zero, not finite, sampled too slowly or not as expected; null if it can."""
    bad = F.when(F.count("x") == 0, "empty").when(F.max(F.abs("x")) == 0, "zero").when(F.bool_or(F.isnan("x") | (F.abs("x") == float("inf"))), "not finite").when(F.first(fs) < least, "slow")
    if expected is not None:
        bad = bad.when(F.abs(F.first(fs) - expected) > 0.01 * expected, "unexpected rate")
    return signal.groupBy(*KEY).agg(F.count("x").alias("n"), bad.alias("problem"))


def sampling_rate(times: DataFrame, time: str = "t") -> DataFrame:
    """fs = 1 / median spacing per channel of (signal_id, channel, time in seconds)."""
    order = Window.partitionBy(*KEY).orderBy(time)
    gaps = times.withColumn("gap", F.col(time) - F.lag(time).over(order))
    return gaps.groupBy(*KEY).agg(F.median("gap").alias("spacing")).where("spacing > 0").withColumn("fs", 1 / F.col("spacing"))


def chunked_rms(signal: DataFrame, size: int) -> DataFrame:
    """RMS of each detrended run of `size` samples; runs of one sample are dropped."""
    chunk = signal.withColumn("chunk", F.floor(F.col("i") / size))
    line = chunk.groupBy(*KEY, "chunk").agg(F.count("*").alias("n"), F.regr_slope("x", "i").alias("slope"), F.regr_intercept("x", "i").alias("start")).where("n >= 2")
    rest = F.col("x") - F.col("slope") * F.col("i") - F.col("start")
    return chunk.join(line, [*KEY, "chunk"]).groupBy(*KEY, "chunk").agg(F.first("n").alias("n"), F.sqrt(F.avg(rest * rest)).alias("rms"))


def hann(i: Column, n: Column) -> Column:
    return F.when(n > 1, 0.5 - 0.5 * F.cos(2 * F.lit(3.141592653589793) * i / (n - 1))).otherwise(1.0)


def fourier_sums(signal: DataFrame, bins: Column) -> DataFrame:
    """Hann-windowed Fourier sums of an array column of bins: bin, n, re, im; one pass of partial aggregation (spectra.spectrum has all bins)."""
    each = signal.withColumn("n", F.count("*").over(whole())).withColumn("bin", F.explode(bins))
    angle = -2 * F.lit(3.141592653589793) * F.col("bin") * F.col("i") / F.col("n")
    w = F.col("x") * hann(F.col("i"), F.col("n"))
    return each.groupBy(*KEY, "bin", "n").agg(F.sum(w * F.cos(angle)).alias("re"), F.sum(w * F.sin(angle)).alias("im"))


def local_maxima(signal: DataFrame) -> DataFrame:
    """Samples above both neighbours, with the parabola through the three: refined place and height."""
    a, b = F.lag("x").over(by_time()), F.lead("x").over(by_time())
    near = signal.withColumns({"a": a, "b": b}).where("a is not null and b is not null and x > a and x > b")
    bend = F.col("a") - 2 * F.col("x") + F.col("b")
    shift = F.when(bend == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (F.col("a") - F.col("b")) / bend)))
    return near.withColumn("shift", shift).select(*KEY, "i", "x", (F.col("i") + F.col("shift")).alias("place"), (F.col("x") - 0.25 * (F.col("a") - F.col("b")) * F.col("shift")).alias("height"))


def coupling_phase(spectra: DataFrame, target: float = 180.0, allowed: float = 30.0) -> DataFrame:
    """Phase difference of each pair of channels of a signal at each bin of `spectra`, and whether it lies within allowed of target."""
    phase = spectra.select("signal_id", "channel", "bin", F.degrees(F.atan2("im", "re")).alias("phase"))
    a, b = phase.alias("a"), phase.alias("b")
    pairs = a.join(b, (F.col("a.signal_id") == F.col("b.signal_id")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.channel") < F.col("b.channel")))
    gap = phase_gap(F.col("a.phase"), F.col("b.phase"))
    return pairs.select("a.signal_id", F.col("a.channel").alias("channel_a"), F.col("b.channel").alias("channel_b"), "a.bin", gap.alias("gap"), (F.abs(gap - target) <= allowed).alias("coupled"))


def nearest_match(targets: DataFrame, peaks: DataFrame, keys: list[str], allowed: Column | None = None) -> DataFrame:
    """For each target the nearest peak of the same keys, if within `allowed` (default: the harmonic tolerance).

    targets: keys, fault, harmonic, base, target. peaks: keys, f, amplitude. Unmatched targets stay with null
    peaks. The join is an equi join on keys; the nearest is chosen by partial aggregation (ties: lower f, then amplitude).
    Targets are many times the bytes of the table that they are made of, which Spark's estimate doesn't see, so both joins are
    merge joins: a broadcast would bring all targets to the driver.
    """
    limit = allowed if allowed is not None else tolerance(F.col("base"), F.col("harmonic"))
    targets = targets.hint("merge")
    both = targets.join(peaks, keys).withColumn("gap", F.abs(F.col("f") - F.col("target"))).where(F.col("gap") <= limit)
    best = both.groupBy(*keys, "fault", "harmonic").agg(F.min_by(F.struct("f", "amplitude"), F.struct("gap", "f", "amplitude")).alias("m"))
    return targets.join(best, [*keys, "fault", "harmonic"], "left").select(*targets.columns, F.col("m.f").alias("found"), F.col("m.amplitude").alias("amplitude"))


def decimate(signal: DataFrame, most: int) -> DataFrame:
    """Every ceil(n / most)-th sample."""
    return signal.withColumn("n", F.count("*").over(whole())).where(F.col("i") % F.ceil(F.col("n") / most) == 0).drop("n")


def thinned(samples: DataFrame, most: int) -> DataFrame:
    """Every ceil(n / most)-th sample of each channel, the first one included."""
    sizes = samples.groupBy("signal_id", "channel").agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return samples.join(sizes, ["signal_id", "channel"]).where(F.col("i") % step == 0).drop("n")


def first_pair(channels: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The first of the pairs of channel names, in any case, of which a signal (signal_id, channel) has both: signal_id, x_channel, y_channel."""
    has = channels.groupBy("signal_id").agg(F.collect_set(F.upper("channel")).alias("names"))  # as many names as a signal has channels
    known = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    fit = F.filter(known, lambda p: F.array_contains(F.col("names"), F.upper(p["a"])) & F.array_contains(F.col("names"), F.upper(p["b"])))
    return has.select("signal_id", F.try_element_at(fit, F.lit(1)).alias("p")).where("p is not null").select("signal_id", F.col("p.a").alias("x_channel"), F.col("p.b").alias("y_channel"))
