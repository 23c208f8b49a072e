"""Queries on vibration signals and faults.

`events` are the samples: a signal per user, a channel per event type, in time order. `part` gives bearing
geometry and `orders` running speeds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona import schemas
from resona.functions import signal as sig
from resona.operators import analysis, faults, kernels, peaks, spectra
from resona.operators import signals as op
from resona.sources import recordings
from resona.sources.held import root
from resona.sources.tables import table

QUERIES, SQL = {}, {}

S = """s AS (
  SELECT user_id AS signal_id, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, value AS x FROM events
)"""
SPECTRUM = """n AS (SELECT *, count(*) OVER (PARTITION BY signal_id, channel) AS n FROM s
), b AS (SELECT *, unnest(range(0, n // 2 + 1)) AS bin FROM n
), w AS (SELECT *, x * CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) ELSE 1 END AS w, -2 * pi() * bin * i / n AS a FROM b
), f AS (SELECT signal_id, channel, bin, n, sum(w * cos(a)) AS re, sum(w * sin(a)) AS im, sqrt(pow(sum(w * cos(a)), 2) + pow(sum(w * sin(a)), 2)) AS mag, bin * 1.0::DOUBLE / n AS frac FROM w GROUP BY ALL
)"""
ZONES = "z(class, zone, lo, hi) AS (VALUES " + ", ".join(f"('{c}', '{z}', {lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)" for c, z, lo, hi in schemas.SEVERITY) + ")"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return op.samples(table(spark, d, "events"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Samples without order, for what needs none."""
    return table(spark, d, "events").select(F.col("user_id").alias("signal_id"), F.col("event_type").alias("channel"), F.col("value").alias("x"))


@query("""SELECT user_id AS signal_id, event_type AS channel, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak,
  round(max(abs(value)) / (sqrt(avg(value * value)) + 1e-9), 6) AS crest, round(kurtosis_pop(value), 5) AS kurtosis FROM events GROUP BY 1, 2""")
def sig_time_stats(spark, d):
    s = op.time_statistics(_raw(spark, d))
    return s.select("signal_id", "channel", "n", *(F.round(c, 6).alias(c) for c in ("rms", "peak", "crest")), F.round("kurtosis", 5).alias("kurtosis"))


@query(f"""WITH {ZONES}, r AS (
  SELECT user_id AS signal_id, event_type AS channel, 'Class ' || ['I', 'II', 'III', 'IV'][1 + user_id % 4] AS class, sqrt(avg(value * value)) / 20 AS rms FROM events GROUP BY 1, 2, 3
) SELECT signal_id, channel, r.class, round(rms, 6) AS rms, zone, CASE zone WHEN 'A' THEN 'Good' WHEN 'B' THEN 'Allowable' WHEN 'C' THEN 'Just Tolerable' ELSE 'Not Permissible' END AS meaning
FROM r JOIN z ON r.class = z.class AND rms >= lo AND (hi IS NULL OR rms < hi)""")
def sig_severity_zone(spark, d):
    graded = op.time_statistics(_raw(spark, d)).select("signal_id", "channel", (F.col("rms") / 20).alias("rms"), sig.machine_class(F.concat(F.lit("class_"), 1 + F.col("signal_id") % 4)).alias("class"))
    return op.severity_zones(graded, schemas.severity(spark)).select("signal_id", "channel", "class", F.round("rms", 6).alias("rms"), "zone", "meaning")


@query(f"""WITH {S}, l AS (SELECT signal_id, channel, coalesce(regr_slope(x, i), 0) AS a, coalesce(regr_intercept(x, i), min(x)) AS b FROM s GROUP BY ALL)
SELECT s.signal_id, s.channel, i, CAST(floor((x - a * i - b) * 10000 + 0.50001) AS BIGINT) AS x_e4 FROM s JOIN l USING (signal_id, channel)""")
def sig_detrend(spark, d):
    return op.detrend(_samples(spark, d)).select("signal_id", "channel", "i", F.floor(F.col("x") * 10000 + 0.50001).alias("x_e4"))


@query("""SELECT user_id AS signal_id, event_type AS channel, count(value) AS n, CASE WHEN count(value) = 0 THEN 'empty' WHEN max(abs(value)) = 0 THEN 'zero'
  WHEN bool_or(isnan(value) OR isinf(value)) THEN 'not finite' WHEN user_id % 3 = 0 THEN 'slow' END AS problem FROM events GROUP BY 1, 2""")
def sig_validate(spark, d):
    return op.validate(_raw(spark, d), F.when(F.col("signal_id") % 3 == 0, 500.0).otherwise(1000.0))


@query("""WITH g AS (SELECT user_id AS signal_id, event_type AS channel, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts)) / 1e6 AS gap FROM events)
SELECT signal_id, channel, CAST(floor(median(gap) * 1000 + 0.50001) AS BIGINT) AS spacing_ms, CAST(floor(1e9 / median(gap) + 0.50001) AS BIGINT) AS nano_hz FROM g GROUP BY ALL HAVING median(gap) > 0""")
def sig_infer_fs(spark, d):
    times = table(spark, d, "events").select(F.col("user_id").alias("signal_id"), F.col("event_type").alias("channel"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1e6).alias("t"))
    return op.sampling_rate(times).select("signal_id", "channel", F.floor(F.col("spacing") * 1000 + 0.50001).alias("spacing_ms"), F.floor(F.col("fs") * 1e9 + 0.50001).alias("nano_hz"))


@query("""SELECT user_id AS signal_id, event_type AS channel, 2000.0::DOUBLE AS fs, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS peak FROM events GROUP BY 1, 2""")
def recordings_read(spark, d):
    """Signals written as WAV files and read back from their folder by ranges of samples."""
    folder = f"{root(spark)}/recordings-{uuid.uuid4().hex[:12]}"
    recordings.write_wav(_samples(spark, d), folder, 2000.0).count()
    read = recordings.load(spark, folder).where("problem is null")
    name = F.regexp_extract("path", r"(\d+)_[^/]*\.wav$", 1).cast("long"), F.regexp_extract("path", r"_([^/_]*)\.wav$", 1)
    long = read.select(name[0].alias("signal_id"), name[1].alias("channel"), "fs", "x")
    s = long.groupBy("signal_id", "channel", "fs").agg(F.count("x").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    return s.select("signal_id", "channel", "fs", "n", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


@query(f"""WITH {S}, c AS (SELECT *, i // 8 AS chunk FROM s), l AS (SELECT signal_id, channel, chunk, count(*) AS n, regr_slope(x, i) AS a, regr_intercept(x, i) AS b FROM c GROUP BY ALL HAVING count(*) >= 2)
SELECT signal_id, channel, chunk, n, round(sqrt(avg(pow(x - a * i - b, 2))), 5) AS rms FROM c JOIN l USING (signal_id, channel, chunk) GROUP BY signal_id, channel, chunk, n""")
def sig_chunked_rms(spark, d):
    return op.chunked_rms(_samples(spark, d), 8).select("signal_id", "channel", "chunk", "n", F.round("rms", 5).alias("rms"))


@query(f"WITH {S}, {SPECTRUM} SELECT signal_id, channel, bin, round(mag, 4) AS mag, round(frac, 6) AS frac FROM f")
def sig_spectrum(spark, d):
    return spectra.spectrum(_samples(spark, d)).select("signal_id", "channel", "bin", F.round("mag", 4).alias("mag"), F.round("frac", 6).alias("frac"))


@query(f"""WITH {S}, g AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM s WINDOW w AS (PARTITION BY signal_id, channel ORDER BY i)
), p AS (SELECT *, CASE WHEN a - 2 * x + b = 0 THEN 0 ELSE greatest(-1, least(1, 0.5 * (a - b) / (a - 2 * x + b))) END AS shift FROM g WHERE x > a AND x > b)
SELECT signal_id, channel, i, round(i + shift, 4) AS place, round(x - 0.25 * (a - b) * shift, 4) AS height FROM p""")
def sig_local_maxima(spark, d):
    return op.local_maxima(_samples(spark, d)).select("signal_id", "channel", "i", F.round("place", 4).alias("place"), F.round("height", 4).alias("height"))


#: Peaks of record r (signal_id, channel, i, x), plateaus by their middle, and their prominence.
PROMINENCE = """c AS (SELECT *, sum(CASE WHEN x = before THEN 0 ELSE 1 END) OVER (PARTITION BY signal_id, channel ORDER BY i) AS run FROM (SELECT *, lag(x) OVER (PARTITION BY signal_id, channel ORDER BY i) AS before FROM r)
), u AS (SELECT signal_id, channel, run, min(i) AS lo, max(i) AS hi, min(x) AS x FROM c GROUP BY ALL
), g AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM u WINDOW w AS (PARTITION BY signal_id, channel ORDER BY run)
), p AS (SELECT signal_id, channel, (lo + hi) // 2 AS i, x FROM g WHERE x > a AND x > b
), e AS (SELECT p.signal_id, p.channel, p.i, p.x, coalesce(max(r.i) FILTER (r.i < p.i AND r.x > p.x), -1) AS l, coalesce(min(r.i) FILTER (r.i > p.i AND r.x > p.x), 1000000000) AS r FROM p JOIN r USING (signal_id, channel) GROUP BY ALL
), k AS (SELECT e.signal_id, e.channel, e.i, e.x - greatest(min(r.x) FILTER (r.i > l AND r.i <= e.i), min(r.x) FILTER (r.i < r AND r.i >= e.i)) AS prominence FROM e JOIN r USING (signal_id, channel) GROUP BY e.signal_id, e.channel, e.i, e.x)"""


@query(f"WITH {S}, r AS (SELECT * FROM s), {PROMINENCE} SELECT signal_id, channel, i, round(prominence, 6) AS prominence FROM k")
def sig_peak_prominence(spark, d):
    return peaks.prominent_peaks(_samples(spark, d)).select("signal_id", "channel", "i", F.round("prominence", 6).alias("prominence"))


#: Simpson weight of the k-th of m values.
SIMPSON = "CASE WHEN m = 2 THEN 0.5 ELSE CASE WHEN k >= m - (m + 1) % 2 THEN 0 WHEN k = 0 OR k = m - (m + 1) % 2 - 1 THEN 1.0::DOUBLE / 3 WHEN k % 2 = 1 THEN 4.0::DOUBLE / 3 ELSE 2.0::DOUBLE / 3 END + CASE WHEN m % 2 = 1 THEN 0 WHEN k = m - 1 THEN 5.0::DOUBLE / 12 WHEN k = m - 2 THEN 8.0::DOUBLE / 12 WHEN k = m - 3 THEN -1.0::DOUBLE / 12 ELSE 0 END END"


@query(f"""WITH {S}, {SPECTRUM}, q AS (SELECT *, frac * 1000 AS fq FROM f), g AS (
  SELECT *, bin - min(bin) OVER w AS k, count(*) OVER w AS m FROM q WHERE fq >= 100 AND fq <= 300 WINDOW w AS (PARTITION BY signal_id, channel)
), a AS (SELECT signal_id, channel, sum(({SIMPSON}) * mag * mag) AS area, max(m) AS m FROM g GROUP BY ALL
), c AS (SELECT DISTINCT ON (signal_id, channel) signal_id, channel, mag FROM q ORDER BY signal_id, channel, abs(fq - 200), fq)
SELECT c.signal_id, c.channel, round(CASE WHEN m > 1 THEN sqrt(greatest(0, area / (m - 1))) ELSE mag END, 4) AS band_rms FROM c LEFT JOIN a USING (signal_id, channel)""")
def sig_band_rms(spark, d):
    found = spectra.spectrum(_samples(spark, d)).withColumn("f", F.col("frac") * 1000)
    return spectra.band_rms(found, F.lit(100.0), F.lit(300.0)).select("signal_id", "channel", F.round("band_rms", 4).alias("band_rms"))


@query(f"""WITH {S}, {SPECTRUM}, p AS (SELECT signal_id, channel, bin, degrees(atan2(im, re)) AS phase FROM f WHERE bin IN (1, 2))
SELECT a.signal_id, a.channel AS channel_a, b.channel AS channel_b, a.bin, round(least(abs(a.phase - b.phase) % 360, 360 - abs(a.phase - b.phase) % 360), 2) AS gap, abs(least(abs(a.phase - b.phase) % 360, 360 - abs(a.phase - b.phase) % 360) - 180) <= 30 AS coupled
FROM p a JOIN p b ON a.signal_id = b.signal_id AND a.bin = b.bin AND a.channel < b.channel""")
def sig_coupling_phase(spark, d):
    n = F.array_compact(F.array(F.lit(1), F.when(F.col("n") >= 4, 2)))
    return op.coupling_phase(op.fourier_sums(_samples(spark, d), n)).withColumn("gap", F.round("gap", 2)).withColumn("bin", F.col("bin").cast("long"))


@query(f"WITH {S}, c AS (SELECT *, count(*) OVER (PARTITION BY signal_id, channel) AS n FROM s) SELECT signal_id, channel, i, x FROM c WHERE i % CAST(ceil(n / 5.0) AS BIGINT) = 0")
def sig_decimate(spark, d):
    return op.decimate(_samples(spark, d), 5)


GEOMETRY = "p_partkey AS part_id, 600.0::DOUBLE + 100 * (p_partkey % 20) AS rpm, p_size AS n, 2.0::DOUBLE + p_size / 10.0::DOUBLE AS d, 20.0::DOUBLE + p_size AS pitch, 5.0::DOUBLE * (p_partkey % 4) AS angle FROM part WHERE p_size >= 2"
FREQUENCIES = f"""g AS (SELECT {GEOMETRY}), h AS (SELECT *, rpm / 60 AS fr, d / pitch * cos(radians(angle)) AS r FROM g),
q AS (SELECT part_id, fr, n / 2.0::DOUBLE * fr * (1 - r) AS bpfo, n / 2.0::DOUBLE * fr * (1 + r) AS bpfi, pitch / (2 * d) * fr * (1 - r * r) AS bsf, fr / 2 * (1 - r) AS ftf FROM h)"""


def _frequencies(spark, d):
    g = table(spark, d, "part").where("p_size >= 2").select(F.col("p_partkey").alias("part_id"), (600.0 + 100 * (F.col("p_partkey") % 20)).alias("rpm"), F.col("p_size").alias("n"), (2 + F.col("p_size") / 10).alias("d"), (20.0 + F.col("p_size")).alias("pitch"), (5.0 * (F.col("p_partkey") % 4)).alias("angle"))
    return g.select("part_id", sig.fault_frequencies(*(F.col(c) for c in ("rpm", "n", "d", "pitch", "angle"))).alias("q")).select("part_id", "q.*")


@query(f"WITH {FREQUENCIES} SELECT part_id, round(fr, 6) AS fr, round(bpfo, 6) AS bpfo, round(bpfi, 6) AS bpfi, round(bsf, 6) AS bsf, round(ftf, 6) AS ftf, round(2 * bsf, 6) AS bsf2 FROM q")
def bearing_fault_freqs(spark, d):
    q = _frequencies(spark, d)
    return q.select("part_id", *(F.round(c, 6).alias(n) for c, n in (("fr", "fr"), ("BPFO", "bpfo"), ("BPFI", "bpfi"), ("BSF", "bsf"), ("FTF", "ftf"), ("2BSF", "bsf2"))))


PEAKS = "k AS (SELECT p_partkey AS part_id, l_orderkey, l_linenumber, l_extendedprice % 400 AS f, l_quantity AS amplitude FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _peaks(spark, d):
    """Lineitems as the detected peaks of their part's spectrum."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), (F.col("l_extendedprice") % 400).alias("f"), F.col("l_quantity").alias("amplitude"))


def _targets(q: DataFrame) -> DataFrame:
    faults_ = F.array(*(F.struct(F.lit(n).alias("fault"), F.col(n).alias("base")) for n in ("BPFO", "BPFI", "BSF", "FTF")))
    return q.select("part_id", F.inline(faults_)).withColumn("harmonic", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("target", F.col("base") * F.col("harmonic"))


@query(f"""WITH {FREQUENCIES}, {PEAKS}, t AS (
  SELECT part_id, unnest(['BPFO', 'BPFI', 'BSF', 'FTF']) AS fault, unnest([bpfo, bpfi, bsf, ftf]) AS base FROM q
), u AS (SELECT *, base * harmonic AS target, greatest(0.5, base * harmonic * 0.015) * (1 + 0.1 * (harmonic - 1)) AS tol FROM t, (SELECT unnest([1, 2, 3]) AS harmonic) x
), m AS (SELECT DISTINCT ON (u.part_id, fault, harmonic) u.part_id, fault, harmonic, f, amplitude FROM u JOIN k ON u.part_id = k.part_id AND abs(f - target) <= tol ORDER BY u.part_id, fault, harmonic, abs(f - target), f, amplitude)
SELECT u.part_id, u.fault, u.harmonic, round(target, 4) AS target, round(f, 4) AS found FROM u LEFT JOIN m USING (part_id, fault, harmonic)""")
def harmonic_match(spark, d):
    m = op.nearest_match(_targets(_frequencies(spark, d)), _peaks(spark, d), ["part_id"])
    return m.select("part_id", "fault", "harmonic", F.round("target", 4).alias("target"), F.round("found", 4).alias("found"))


@query(f"""WITH {FREQUENCIES}, {PEAKS}, t AS (
  SELECT part_id, 'BPFI' AS fault, o AS harmonic, bpfi + o * fr AS target FROM q, (SELECT unnest([-2, -1, 1, 2]) AS o) x UNION ALL
  SELECT part_id, 'BSF' AS fault, o AS harmonic, bsf + o * ftf AS target FROM q, (SELECT unnest([-2, -1, 1, 2]) AS o) x
), u AS (SELECT * FROM t WHERE target >= 0.5), m AS (SELECT DISTINCT ON (u.part_id, fault, harmonic) u.part_id, fault, harmonic, f FROM u JOIN k ON u.part_id = k.part_id AND abs(f - target) <= greatest(0.5, target * 0.015) ORDER BY u.part_id, fault, harmonic, abs(f - target), f)
SELECT u.part_id, u.fault, u.harmonic AS side, round(target, 4) AS target, round(f, 4) AS found FROM u LEFT JOIN m USING (part_id, fault, harmonic)""")
def sideband_match(spark, d):
    q = _frequencies(spark, d)
    sides = F.array(*(F.struct(F.lit(n).alias("fault"), F.lit(o).alias("harmonic"), (F.col(n) + o * F.col(s)).alias("target")) for n, s in (("BPFI", "fr"), ("BSF", "FTF")) for o in (-2, -1, 1, 2)))
    targets = q.select("part_id", F.inline(sides)).where("target >= 0.5")
    m = op.nearest_match(targets, _peaks(spark, d), ["part_id"], F.greatest(F.lit(0.5), F.col("target") * 0.015))
    return m.select("part_id", "fault", F.col("harmonic").alias("side"), F.round("target", 4).alias("target"), F.round("found", 4).alias("found"))


@query(f"""WITH {FREQUENCIES}, {PEAKS}, u AS (SELECT part_id, unnest(['shaft', 'twice', 'half']) AS name, unnest([fr, 2 * fr, fr / 2]) AS target FROM q
), m AS (SELECT DISTINCT ON (u.part_id, name) u.part_id, name, f FROM u JOIN k ON u.part_id = k.part_id AND abs(f - target) <= 2 ORDER BY u.part_id, name, abs(f - target), f)
SELECT u.part_id, u.name, round(target, 4) AS target, f IS NOT NULL AS matched, round(abs(f - target), 4) AS gap FROM u LEFT JOIN m USING (part_id, name)""")
def named_match(spark, d):
    named = F.array(*(F.struct(F.lit(n).alias("fault"), F.lit(1).alias("harmonic"), (F.col("fr") * k).alias("target")) for n, k in (("shaft", 1.0), ("twice", 2.0), ("half", 0.5))))
    m = op.nearest_match(_frequencies(spark, d).select("part_id", F.inline(named)), _peaks(spark, d), ["part_id"], F.lit(2.0))
    return m.select("part_id", F.col("fault").alias("name"), F.round("target", 4).alias("target"), F.col("found").isNotNull().alias("matched"), F.round(F.abs(F.col("found") - F.col("target")), 4).alias("gap"))


AMPLITUDES = """a AS (SELECT user_id AS signal_id, CASE event_id % 7 WHEN 6 THEN 0.5 ELSE event_id % 7 + 1.0 END AS o, sqrt(avg(value * value)) AS amplitude FROM events WHERE event_id % 7 <> 5 GROUP BY 1, 2
), base AS (SELECT user_id AS signal_id, median(value) AS baseline FROM events GROUP BY 1
), m AS (SELECT a.signal_id, CAST(o AS DOUBLE) AS o, CASE WHEN amplitude > 2 * baseline THEN amplitude ELSE 0 END AS amplitude, baseline FROM a JOIN base USING (signal_id))"""
RATIOS = AMPLITUDES + """, g AS (SELECT signal_id, coalesce(max(amplitude) FILTER (o = 1), 0) AS a1, coalesce(max(amplitude) FILTER (o = 2), 0) AS a2, coalesce(max(amplitude) FILTER (o = 0.5), 0) AS sub, max(baseline) AS b,
  coalesce(sum(amplitude) FILTER (o >= 2), 0) AS higher, count(*) FILTER (o >= 1 AND amplitude / baseline > 3) AS strong, sum(amplitude) AS energy FROM m GROUP BY 1
), r AS (SELECT signal_id, 'unbalance' AS fault, CASE WHEN a1 > 0 THEN a1 / b ELSE 0 END AS severity, CASE WHEN a1 > 0 THEN greatest(0, 1 - higher / a1) ELSE 0 END AS confidence FROM g
  UNION ALL SELECT signal_id, 'misalignment', CASE WHEN a2 > 0 THEN a2 / b ELSE 0 END, CASE WHEN a2 > 0 AND a1 > 0 THEN least(1, a2 / a1 / 0.5) WHEN a2 > 0 THEN 0.5 ELSE 0 END FROM g
  UNION ALL SELECT signal_id, 'looseness', CASE WHEN strong >= 2 OR sub > 0 THEN energy / b ELSE 0 END, CASE WHEN strong >= 2 OR sub > 0 THEN least(1, strong / 5.0 + CASE WHEN sub > 0 THEN 0.2 ELSE 0 END) ELSE 0 END FROM g)"""


def _amplitudes(spark, d):
    """Order amplitudes of a signal: events dealt to orders 1 to 5 and 0.5, those that stand out over the median."""
    events = table(spark, d, "events").select(F.col("user_id").alias("signal_id"), "value", (F.col("event_id") % 7).alias("k"))
    a = events.where("k <> 5").groupBy("signal_id", F.when(F.col("k") == 6, 0.5).otherwise(F.col("k") + 1.0).alias("order")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("amplitude"))
    base = events.groupBy("signal_id").agg(F.median("value").alias("baseline"))
    return a.join(base, "signal_id").withColumn("amplitude", F.when(F.col("amplitude") > 2 * F.col("baseline"), F.col("amplitude")).otherwise(0.0))


@query(f"WITH {RATIOS} SELECT signal_id, fault, round(severity, 3) AS severity, round(confidence, 3) AS confidence FROM r")
def ratio_pattern(spark, d):
    return faults.ratio_patterns(_amplitudes(spark, d)).select("signal_id", "fault", F.round("severity", 3).alias("severity"), F.round("confidence", 3).alias("confidence"))


@query(f"""WITH {RATIOS}, o AS (SELECT DISTINCT ON (signal_id) signal_id, o AS observed_order FROM m WHERE o >= 1 ORDER BY signal_id, amplitude DESC, o),
p(pattern_no, fault, direction, dominant_order) AS (VALUES (1, 'unbalance', 'radial', 1.0::DOUBLE), (2, 'angular_misalignment', 'axial', 1.0), (3, 'parallel_misalignment', 'radial', 2.0), (4, 'mechanical_looseness_internal', 'radial', 2.0), (5, 'mechanical_looseness', 'radial', 2.0), (6, 'mechanical_looseness', 'radial', 2.0))
SELECT signal_id, observed_order, pattern_no, fault, direction FROM o JOIN p ON observed_order = dominant_order""")
def pattern_cross_check(spark, d):
    """All patterns of the observed dominant order: it alone doesn't tell faults apart."""
    return faults.cross_check(faults.dominant_order(_amplitudes(spark, d)), schemas.patterns(spark)).select("signal_id", "observed_order", "pattern_no", "fault", "direction")


#: Mean of values as whole millionths, whose sum doesn't depend on the order of rows; the mean of doubles where one is no number.
MEAN = "CASE WHEN bool_or(isnan(value) OR isinf(value)) THEN avg(value) ELSE CAST(sum(CAST(CASE WHEN NOT isnan(value) AND NOT isinf(value) THEN floor(value * 1e6::DOUBLE + 0.5::DOUBLE) END AS BIGINT)) AS DOUBLE) / (nullif(count(value), 0) * 1e6::DOUBLE) END"


def _mean(value: str):
    x = F.col(value)
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    exact = F.sum(F.when(~odd, F.floor(x * 1e6 + 0.5))).cast("double") / (F.nullif(F.count(x), F.lit(0)) * 1e6)
    return F.when(F.bool_or(odd), F.avg(x)).otherwise(exact)


def _half_up(x, unit: float):
    """x to whole units: floor(x * unit + 0.5) / unit, as SQL has it; what is no number stays."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * unit + 0.5) / unit)


CANDIDATES = f"""c AS (
  SELECT user_id AS signal_id, min(event_id) AS ordinal, CASE WHEN event_type IN ('click', 'view') THEN 'envelope' WHEN event_type = 'error' THEN 'direct' ELSE 'reciprocating' END AS category,
    CASE min(event_id) % 4 WHEN 0 THEN 'BPFO' WHEN 1 THEN 'BPFI' WHEN 2 THEN 'BSF' ELSE 'FTF' END AS code, floor({MEAN} / 25 * 100 + 0.5) / 100 AS severity, (200 * count(*) FILTER (value > 10) + count(*)) // (2 * count(*)) / 100 AS confidence,
    count(*) FILTER (value > 30) AS h, max(value) > 60 AS sb FROM events GROUP BY user_id, event_type
), k AS (SELECT *, CASE WHEN severity > 0 THEN least(severity, 10) ELSE 1 END AS cap FROM c WHERE confidence > 0 OR severity > 0 OR h > 0
), v AS (SELECT *, CASE WHEN category = 'envelope' THEN confidence * (cap + h * 1.5) * CASE WHEN sb AND code = 'BSF' THEN 2 WHEN sb THEN 1.5 ELSE 1 END * CASE WHEN code = 'FTF' THEN 0.6 ELSE 1 END ELSE confidence * cap END AS score,
  CASE category WHEN 'direct' THEN confidence >= 0.5 AND severity >= 0.5 WHEN 'envelope' THEN (h >= 2 AND confidence >= 0.4) OR (h >= 1 AND sb AND confidence >= 0.33) ELSE confidence >= 0.5 END AS strong FROM k)"""


@query(f"WITH {CANDIDATES} SELECT signal_id, category, code, CAST(floor(score * 1000 + 0.50001) AS BIGINT) AS score_e3, strong, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY strong DESC, score DESC, severity DESC, ordinal) AS INTEGER) AS rank FROM v")
def primary_fault_rank(spark, d):
    e = table(spark, d, "events")
    first = F.min("event_id")
    stats = e.groupBy(F.col("user_id").alias("signal_id"), "event_type").agg(
        first.alias("ordinal"), F.element_at(F.array(*map(F.lit, ("BPFO", "BPFI", "BSF", "FTF"))), (first % 4 + 1).cast("int")).alias("code"), _half_up(_mean("value") / 25, 100).alias("severity"),
        (F.floor((200 * F.count_if(F.col("value") > 10) + F.count("*")) / (2 * F.count("*"))) / 100).alias("confidence"), F.count_if(F.col("value") > 30).alias("n_harmonics"), (F.max("value") > 60).alias("sidebands"),
    )
    branches = [stats.where(F.col("event_type").isin("click", "view")).withColumn("category", F.lit("envelope")), stats.where("event_type = 'error'").withColumn("category", F.lit("direct")), stats.where(~F.col("event_type").isin("click", "view", "error")).withColumn("category", F.lit("reciprocating"))]
    ranked = faults.rank_faults(branches[0].unionByName(branches[1]).unionByName(branches[2]))
    return ranked.select("signal_id", "category", "code", F.floor(F.col("score") * 1000 + 0.50001).alias("score_e3"), "strong", "rank")


@query(f"""WITH v AS (SELECT user_id AS signal_id, ['BPFO', 'BPFI', 'BSF', 'FTF'][1 + event_id % 4] AS fault, event_type AS channel, CASE WHEN {MEAN} < 5 THEN 0 ELSE {MEAN} END AS severity FROM events GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, fault ORDER BY severity DESC, channel) AS k FROM v
), t AS (SELECT signal_id, fault, max(channel) FILTER (k = 1) AS c1, max(severity) FILTER (k = 1) AS s1, max(severity) FILTER (k = 2) AS s2 FROM r WHERE k <= 2 GROUP BY ALL
), w AS (SELECT *, CASE WHEN s1 <= 0 THEN 'none' WHEN coalesce(s2, 0) <= 0 THEN 'sole' WHEN s1 / s2 >= 1.5 THEN 'dominant' ELSE 'unclear' END AS verdict FROM t)
SELECT signal_id, fault, verdict, CASE WHEN verdict IN ('sole', 'dominant') THEN c1 END AS dominant_channel, floor(CASE WHEN s2 > 0 THEN s1 / s2 END * 10000 + 0.5) / 10000 AS ratio FROM w""")
def localize_fault(spark, d):
    e = table(spark, d, "events")
    fault = F.element_at(F.array(*map(F.lit, ("BPFO", "BPFI", "BSF", "FTF"))), (F.col("event_id") % 4 + 1).cast("int"))
    severity = e.groupBy(F.col("user_id").alias("signal_id"), fault.alias("fault"), F.col("event_type").alias("channel")).agg(F.when(_mean("value") < 5, 0.0).otherwise(_mean("value")).alias("severity"))
    return faults.localise(severity).withColumn("ratio", _half_up(F.col("ratio"), 10000))


@query("""WITH m AS (SELECT o_orderkey AS machine_id, o_totalprice / 20 AS rpm FROM orders WHERE o_totalprice > 0), f(filter_no, blo, bhi, slo, shi) AS (VALUES (1, 5, 100, 0, 50), (2, 50, 1000, 25, 500), (3, 500, 10000, 250, 5000), (4, 5000, 40000, 2500, NULL)),
x AS (SELECT *, greatest(0, slo - rpm, CASE WHEN shi IS NULL THEN 0 ELSE rpm - shi END) AS far FROM m, f)
SELECT DISTINCT ON (machine_id) machine_id, round(rpm, 4) AS rpm, filter_no, blo::DOUBLE AS band_lo, bhi::DOUBLE AS band_hi FROM x ORDER BY machine_id, far, filter_no""")
def band_filter_select(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("machine_id"), (F.col("o_totalprice") / 20).alias("rpm"))
    return faults.band_filter(m, schemas.filters(spark)).withColumn("rpm", F.round("rpm", 4))


RECIPROCATING = """m AS (SELECT p_partkey AS machine_id, 600.0::DOUBLE + 100 * (p_partkey % 20) AS rpm, p_size AS c, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 2 END AS st FROM part),
r AS (SELECT machine_id, rpm / 60 AS fr, unnest([1, 1, 2, 3, 4, 5, 6, 7]) AS row_no, unnest([1.0::DOUBLE, 2.0, CASE WHEN st = 4 THEN c ELSE c / 2.0 END, CASE WHEN st = 4 THEN 0.5 ELSE 1 END, 2.0, CASE WHEN st = 4 THEN c ELSE c / 2.0 END, 2.0, 2.0]) AS multiple FROM m)"""


def _reciprocating(spark, d):
    m = table(spark, d, "part").select(F.col("p_partkey").alias("machine_id"), (600.0 + 100 * (F.col("p_partkey") % 20)).alias("rpm"), F.col("p_size").alias("cylinders"), F.when(F.col("p_partkey") % 2 == 0, 4).otherwise(2).alias("strokes"))
    return faults.reciprocating_frequencies(m, schemas.reciprocating(spark))


@query(f"WITH {RECIPROCATING} SELECT machine_id, row_no, multiple, round(multiple * fr, 6) AS hz FROM r")
def recip_freqs(spark, d):
    return _reciprocating(spark, d).select("machine_id", "row_no", "multiple", F.round("hz", 6).alias("hz"))


MECHANISMS = "n(row_no, at_multiple, mechanism, cause, remedy) AS (VALUES " + ", ".join(f"({r}, {'NULL' if o is None else o}::DOUBLE, '{m}', '{c}', '{e}')" for r, o, m, c, e in schemas.MECHANISMS) + ")"


@query(f"""WITH {RECIPROCATING}, {MECHANISMS}, t AS (SELECT machine_id, mechanism, cause, remedy, multiple * fr AS hz FROM r JOIN n ON r.row_no = n.row_no AND (at_multiple IS NULL OR at_multiple = multiple)
), k AS (SELECT l_partkey AS machine_id, l_extendedprice % 400 AS f, l_quantity AS amplitude FROM lineitem
), l AS (SELECT machine_id, max(f) AS last, median(amplitude) FILTER (amplitude > 0) AS baseline FROM k GROUP BY 1
), u AS (SELECT t.*, CASE WHEN hz < last THEN hz END AS target, baseline FROM t LEFT JOIN l USING (machine_id)
), b AS (SELECT DISTINCT ON (u.machine_id, mechanism) u.machine_id, mechanism, f, amplitude FROM u JOIN k ON k.machine_id = u.machine_id AND abs(f - target) <= 2 ORDER BY u.machine_id, mechanism, abs(f - target), f, amplitude)
SELECT machine_id, mechanism, f IS NOT NULL AS matched, round(target, 4) AS target, round(f, 4) AS found, round(coalesce(amplitude / baseline, 0), 4)::DOUBLE AS severity, cause, remedy FROM u LEFT JOIN b USING (machine_id, mechanism)""")
def reciprocating_diagnosis(spark, d):
    diagnosed = faults.reciprocating_diagnosis(_reciprocating(spark, d), _peaks(spark, d).withColumnRenamed("part_id", "machine_id"), schemas.mechanisms(spark))
    return diagnosed.withColumns({c: F.round(c, 4) for c in ("target", "found", "severity")})


@query("""WITH m AS (SELECT s_suppkey, (s_suppkey % 90 * 10)::VARCHAR || ' – ' || CASE WHEN s_suppkey % 5 = 0 THEN '...' ELSE (s_suppkey % 90 * 10 + 1500)::VARCHAR END || ' RPM' AS t FROM supplier)
SELECT s_suppkey, (s_suppkey % 90 * 10)::DOUBLE AS lo, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 90 * 10 + 1500)::DOUBLE END AS hi, 'Class ' || ['I', 'II', 'III', 'IV'][1 + s_suppkey % 4] AS class FROM m""")
def parse_rules(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 90 * 10).alias("lo"))
    text = F.concat(F.format_number("lo", 0), F.lit(" – "), F.when(F.col("s_suppkey") % 5 == 0, "...").otherwise(F.format_number(F.col("lo") + 1500, 0)), F.lit(" RPM"))
    r = s.select("s_suppkey", sig.parse_range(text).alias("r"), sig.machine_class(F.element_at(F.array(*map(F.lit, ("class_1", "Class II", "3", "iv"))), (F.col("s_suppkey") % 4 + 1).cast("int"))).alias("class"))
    return r.select("s_suppkey", "r.lo", F.when(F.col("r.hi") < float("inf"), F.col("r.hi")).alias("hi"), "class")


@query()
def kurtogram_bands(spark, d):
    return kernels.kurtograms(_samples(spark, d), 1000.0)


@query()
def kurtogram_reliability(spark, d):
    """Whether each channel's chosen band stands out from those of its shuffled samples."""
    return kernels.bands(_samples(spark, d), 1000.0)


@query()
def envelope_diagnosis(spark, d):
    """Bearing faults per channel; where a kurtogram isn't reliable, the envelope filter of the machine's speed gives the band."""
    q = F.expr("named_struct('BPFO', 107.4D, 'BPFI', 162.2D, 'BSF', 70.5D, 'FTF', 11.9D)")
    speeds = table(spark, d, "events").select(F.col("user_id").alias("machine_id")).distinct().withColumn("rpm", F.lit(1800.0))
    other = faults.band_filter(speeds, schemas.filters(spark)).withColumnRenamed("machine_id", "signal_id")
    return kernels.envelope_faults(_samples(spark, d).withColumn("frequencies", q), 1000.0, 30.0, fallback=other)


#: The primary channel of each signal, detrended, as s; m: the machine, whose shaft turns twice in that record.
PRIMARY = S.replace("s AS (", "s0 AS (", 1) + """, pc AS (SELECT signal_id, min(channel) AS channel FROM s0 GROUP BY 1
), pr AS (SELECT s0.* FROM s0 JOIN pc USING (signal_id, channel)
), ln AS (SELECT signal_id, coalesce(regr_slope(x, i), 0) AS a, coalesce(regr_intercept(x, i), min(x)) AS b FROM pr GROUP BY 1
), s AS (SELECT signal_id, channel, i, x - a * i - b AS x FROM pr JOIN ln USING (signal_id)
), m AS (SELECT signal_id, channel, count(*) AS n, CASE WHEN signal_id % 3 = 0 THEN 'reciprocating' ELSE 'rotating' END AS machine, (signal_id % 70) / 10.0::DOUBLE AS velocity, 'Class ' || ['I', 'II', 'III', 'IV'][1 + signal_id % 4] AS class,
  2 + signal_id % 5 AS c, CASE WHEN signal_id % 2 = 0 THEN 4 ELSE 2 END AS st FROM pr GROUP BY ALL)"""


@query(f"""WITH {PRIMARY}, {SPECTRUM}, r AS (SELECT signal_id, channel, bin AS i, mag AS x FROM f), {PROMINENCE.replace("), k AS", "), kk AS")}, {ZONES}, {MECHANISMS}, t AS (
  SELECT signal_id, count(*) AS n, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak, max(abs(x)) / (sqrt(avg(x * x)) + 1e-9) AS crest, CASE WHEN count(*) >= 8 THEN kurtosis_pop(x) END AS kurtosis FROM s GROUP BY 1
), ba AS (SELECT signal_id, median(mag) FILTER (mag > 0) AS b, max(mag) AS top FROM f WHERE n >= 8 GROUP BY 1
), o AS (SELECT m.signal_id, machine, h AS o, b, CASE WHEN kk.prominence >= 2 * b THEN f.mag ELSE 0 END AS amplitude FROM m JOIN ba USING (signal_id), (SELECT unnest([0.5::DOUBLE, 1, 2, 3, 4, 5]) AS h) x
  LEFT JOIN f ON f.signal_id = m.signal_id AND f.bin = 2 * h LEFT JOIN kk ON kk.signal_id = m.signal_id AND kk.i = 2 * h WHERE machine = 'rotating' AND (h < 1 OR 2 * h < m.n // 2)
), gg AS (SELECT signal_id, coalesce(max(amplitude) FILTER (o = 1), 0) AS a1, coalesce(max(amplitude) FILTER (o = 2), 0) AS a2, coalesce(max(amplitude) FILTER (o = 0.5), 0) AS sub, max(b) AS b,
  coalesce(sum(amplitude) FILTER (o >= 2), 0) AS higher, count(*) FILTER (o >= 1 AND amplitude / b > 3) AS strong, sum(amplitude) AS energy FROM o GROUP BY 1
), d AS (SELECT DISTINCT ON (signal_id) signal_id, o AS observed_order FROM o WHERE o >= 1 ORDER BY signal_id, amplitude DESC, o
), rr AS (SELECT signal_id, m.n, unnest([1, 1, 2, 3, 4, 5, 6, 7]) AS row_no, unnest([1.0::DOUBLE, 2.0, CASE WHEN st = 4 THEN c ELSE c / 2.0 END, CASE WHEN st = 4 THEN 0.5 ELSE 1 END, 2.0, CASE WHEN st = 4 THEN c ELSE c / 2.0 END, 2.0, 2.0]) AS multiple FROM m WHERE machine = 'reciprocating'
), rm AS (SELECT rr.signal_id, count(*) FILTER (kk.prominence >= greatest(0.05 * top, 1.5 * b)) AS matched, coalesce(sum(f.mag / b) FILTER (kk.prominence >= greatest(0.05 * top, 1.5 * b)), 0) AS severity
  FROM rr JOIN mn ON rr.row_no = mn.row_no AND (at_multiple IS NULL OR at_multiple = multiple) JOIN ba USING (signal_id) LEFT JOIN f ON f.signal_id = rr.signal_id AND f.bin = 2 * multiple AND 2 * multiple < rr.n // 2 LEFT JOIN kk ON kk.signal_id = rr.signal_id AND kk.i = f.bin GROUP BY 1)
SELECT m.signal_id, machine, m.channel AS primary_channel, t.n, round(t.rms, 5) AS rms, round(crest, 5) AS crest, round(kurtosis, 4) AS kurtosis, zone, observed_order, CASE observed_order WHEN 1 THEN 2 WHEN 2 THEN 4 END AS n_patterns,
  round(CASE WHEN gg.b IS NOT NULL THEN CASE WHEN a1 > 0 THEN a1 / gg.b ELSE 0 END END, 3) AS unbalance, round(CASE WHEN gg.b IS NOT NULL THEN CASE WHEN a2 > 0 THEN a2 / gg.b ELSE 0 END END, 3) AS misalignment,
  round(CASE WHEN gg.b IS NOT NULL THEN CASE WHEN strong >= 2 OR sub > 0 THEN energy / gg.b ELSE 0 END END, 3) AS looseness, CAST(matched AS INTEGER) AS n_matched, round(rm.severity, 3) AS engine_severity
FROM m JOIN t USING (signal_id) LEFT JOIN z ON z.class = m.class AND velocity >= lo AND (hi IS NULL OR velocity < hi) LEFT JOIN gg USING (signal_id) LEFT JOIN d USING (signal_id) LEFT JOIN rm USING (signal_id)""".replace(MECHANISMS, MECHANISMS.replace("n(row_no", "mn(row_no", 1)))
def signal_analysis(spark, d):
    """What SQL can tell of the whole analysis; signal_diagnosis has the rest."""
    a = _analysis(spark, d)
    of = lambda fault: F.round(F.filter("direct", lambda s: s["fault"] == fault)[0]["severity"], 3).alias(fault)
    hits = F.filter("reciprocating", lambda s: s["matched"])
    return a.select(
        "signal_id", "machine", "primary_channel", "stats.n", F.round("stats.rms", 5).alias("rms"), F.round("stats.crest", 5).alias("crest"), F.round("stats.kurtosis", 4).alias("kurtosis"), "severity.zone", "observed_order",
        F.when(F.col("matches").isNotNull(), F.size("matches")).alias("n_patterns"), of("unbalance"), of("misalignment"), of("looseness"),
        F.when(F.col("reciprocating").isNotNull(), F.size(hits)).alias("n_matched"), F.round(F.aggregate(hits, F.lit(0.0), lambda s, h: s + h["severity"]), 3).alias("engine_severity"),
    )


@query()
def signal_diagnosis(spark, d):
    """Band, envelope faults, localisation and the best candidate of each signal."""
    return _analysis(spark, d).select("signal_id", "band.*", F.size("envelope").alias("n_faults"), "localisation", "primary.*")


def _analysis(spark: SparkSession, d: str) -> DataFrame:
    """Signals of events; the shaft turns twice in a signal's primary record."""
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("signal_id"), F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    s = F.col("signal_id")
    machines = counts.groupBy("signal_id").agg(F.min_by("n", "channel").alias("n")).select(
        "signal_id", F.lit(1000.0).alias("fs"), (120 * 1000.0 / F.col("n")).alias("rpm"), F.when(s % 3 == 0, "Piston pump").otherwise("fan").alias("kind"), F.concat(F.lit("class_"), 1 + s % 4).alias("class"), (s % 70 / 10.0).alias("velocity_rms"),
        F.lit(9).alias("n_balls"), F.lit(0.3126).alias("ball"), F.lit(1.537).alias("pitch"), F.lit(0.0).alias("angle"), (2 + s % 5).cast("int").alias("cylinders"), F.when(s % 2 == 0, 4).otherwise(2).alias("strokes"),
    )
    return analysis.signal_analysis(_samples(spark, d), machines, schemas.severity(spark), schemas.filters(spark), schemas.reciprocating(spark), schemas.mechanisms(spark), schemas.patterns(spark))
