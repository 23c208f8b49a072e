"""Column expressions for machine kinematics and parsing of rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULTS = ("BPFO", "BPFI", "BSF", "FTF", "2BSF")


def fault_frequencies(rpm: Column, n: Column, d: Column, pitch: Column, angle: Column) -> Column:
    """Struct of shaft and bearing fault frequencies in Hz; null where the geometry is impossible."""
    fr = rpm / 60.0
    r = d / pitch * F.cos(F.radians(angle))
    bsf = pitch / (2 * d) * fr * (1 - r * r)
    valid = (n >= 2) & (rpm > 0) & (d > 0) & (pitch > 0) & (d < pitch)
    return F.when(valid, F.struct(fr.alias("fr"), (n / 2 * fr * (1 - r)).alias("BPFO"), (n / 2 * fr * (1 + r)).alias("BPFI"), bsf.alias("BSF"), (fr / 2 * (1 - r)).alias("FTF"), (2 * bsf).alias("2BSF")))


def tolerance(base: Column, harmonic: Column, least: float = 0.5, ratio: float = 0.015, alpha: float = 0.10) -> Column:
    """Half width in Hz within which a peak counts as the given harmonic of base."""
    return F.greatest(F.lit(least), base * harmonic * ratio) * (1 + alpha * (harmonic - 1))


def machine_class(text: Column) -> Column:
    """'class_2', 'Class II', '2' or 'II' as 'Class II'; null for others."""
    short = F.trim(F.regexp_replace(F.upper(text.cast("string")), "CLASS|_", " "))
    names = F.create_map(*(F.lit(x) for pair in (("1", "I"), ("2", "II"), ("3", "III"), ("4", "IV"), ("I", "I"), ("II", "II"), ("III", "III"), ("IV", "IV")) for x in pair))
    return F.when(F.try_element_at(names, short).isNotNull(), F.concat(F.lit("Class "), F.try_element_at(names, short)))


def parse_range(text: Column) -> Column:
    """'2,500 – ... RPM' as struct(lo, hi); an open end is infinite, an unreadable start 0."""
    parts = F.split(F.regexp_replace(text, "[^0-9.–-]", ""), "[–-]")
    lo, hi = (F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2))
    return F.struct(F.coalesce(lo, F.lit(0.0)).alias("lo"), F.coalesce(hi, F.lit(float("inf"))).alias("hi"))


def clean(text: Column) -> Column:
    """Line breaks and runs of spaces to one space, multiplication signs to x."""
    return F.trim(F.regexp_replace(F.translate(text, "×\n", "x "), r"\s+", " "))


def multipliers(text: Column) -> Column:
    """All numeric multipliers of a text such as '1x and 2xRPM'."""
    return F.transform(F.regexp_extract_all(clean(text), F.lit(r"(\d+(?:\.\d+)?)\s*[xX]"), F.lit(1)), lambda v: v.cast("double"))


def stroke_multiplier(text: Column, strokes: int) -> Column:
    """The multiplier that a text gives for 4- or 2-stroke engines, as written ('N', 'N/2' or a number); null if none."""
    found = F.regexp_extract(clean(text), rf"(N/2|N|\d+(?:\.\d+)?)\s*[xX]\s*RPM for {strokes}-stroke", 1)
    return F.nullif(found, F.lit(""))


def phase_gap(a: Column, b: Column) -> Column:
    """Difference of two phases in degrees, wrapped into [0, 180]."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)
