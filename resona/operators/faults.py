"""Faults: ratio patterns, candidate ranking, localisation, pattern cross-check, reciprocating frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.functions.signal import clean, multipliers, parse_range, stroke_multiplier
from resona.operators.signals import nearest_match


def ratio_patterns(amplitudes: DataFrame, harmonics: int = 5) -> DataFrame:
    """Unbalance, misalignment and looseness per signal from order amplitudes.

    amplitudes: signal_id, order (0.5, 1, 2, ..), amplitude (0 where no peak stands out), baseline.
    """
    at = lambda k: F.coalesce(F.max(F.when(F.col("order") == k, F.col("amplitude"))), F.lit(0.0))
    whole = F.col("order") >= 1
    g = amplitudes.groupBy("signal_id").agg(
        at(1).alias("a1"), at(2).alias("a2"), at(0.5).alias("sub"), F.max("baseline").alias("baseline"),
        F.coalesce(F.sum(F.when(F.col("order") >= 2, F.col("amplitude"))), F.lit(0.0)).alias("higher"),
        F.count_if(whole & (F.col("amplitude") / F.col("baseline") > 3)).alias("strong"), F.sum("amplitude").alias("energy"),
    )
    a1, a2, base, sub = F.col("a1"), F.col("a2"), F.col("baseline"), F.col("sub")
    loose = (F.col("strong") >= 2) | (sub > 0)
    rows = F.array(
        F.struct(F.lit("unbalance").alias("fault"), F.when(a1 > 0, a1 / base).otherwise(0.0).alias("severity"), F.when(a1 > 0, F.greatest(F.lit(0.0), 1 - F.col("higher") / a1)).otherwise(0.0).alias("confidence")),
        F.struct(F.lit("misalignment").alias("fault"), F.when(a2 > 0, a2 / base).otherwise(0.0).alias("severity"), F.when((a2 > 0) & (a1 > 0), F.least(F.lit(1.0), a2 / a1 / 0.5)).when(a2 > 0, 0.5).otherwise(0.0).alias("confidence")),
        F.struct(F.lit("looseness").alias("fault"), F.when(loose, F.col("energy") / base).otherwise(0.0).alias("severity"), F.when(loose, F.least(F.lit(1.0), F.col("strong") / harmonics + F.when(sub > 0, 0.2).otherwise(0.0))).otherwise(0.0).alias("confidence")),
    )
    return g.select("signal_id", F.inline(rows))


def candidate_score(category: Column, code: Column, confidence: Column, severity: Column, n_harmonics: Column, sidebands: Column) -> Column:
    """Score of a fault candidate: confidence times capped severity, with bonuses for harmonics and sidebands in the envelope."""
    capped = F.when(severity > 0, F.least(severity, F.lit(10.0))).otherwise(1.0)
    base = confidence * (capped + n_harmonics * 1.5)
    bonus = base * F.when(sidebands & (code == "BSF"), 2.0).when(sidebands, 1.5).otherwise(1.0) * F.when(code == "FTF", 0.6).otherwise(1.0)
    return F.when(category == "envelope", bonus).otherwise(confidence * capped)


def strong(category: Column, confidence: Column, severity: Column, n_harmonics: Column, sidebands: Column) -> Column:
    """Whether a candidate's evidence suffices."""
    envelope = ((n_harmonics >= 2) & (confidence >= 0.40)) | ((n_harmonics >= 1) & sidebands & (confidence >= 0.33))
    return F.when(category == "direct", (confidence >= 0.5) & (severity >= 0.5)).when(category == "envelope", envelope).otherwise(confidence >= 0.5)


def rank_faults(candidates: DataFrame) -> DataFrame:
    """Candidates with score, strong and rank: strong ones first, then by score and severity, then in order of `ordinal`."""
    args = [F.col(c) for c in ("confidence", "severity", "n_harmonics", "sidebands")]
    scored = candidates.where("confidence > 0 or severity > 0 or n_harmonics > 0")
    scored = scored.withColumns({"score": candidate_score(F.col("category"), F.col("code"), *args), "strong": strong(F.col("category"), *args)})
    order = Window.partitionBy("signal_id").orderBy(F.desc("strong"), F.desc("score"), F.desc("severity"), "ordinal")
    return scored.withColumn("rank", F.row_number().over(order))


def localise(severities: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Per signal and fault: the channel of the greatest severity, if it leads the second by the threshold.

    severities: signal_id, fault, channel, severity. verdict: none, sole, dominant or unclear.
    """
    order = Window.partitionBy("signal_id", "fault").orderBy(F.desc("severity"), "channel")
    two = severities.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    top = two.groupBy("signal_id", "fault").agg(*(F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}{k}") for c, k in (("channel", 1), ("severity", 1), ("severity", 2))))
    second, ratio = F.coalesce("severity2", F.lit(0.0)), F.col("severity1") / F.col("severity2")
    verdict = F.when(F.col("severity1") <= 0, "none").when(second <= 0, "sole").when(ratio >= threshold, "dominant").otherwise("unclear")
    return top.select("signal_id", "fault", verdict.alias("verdict"), F.when(verdict.isin("sole", "dominant"), F.col("channel1")).alias("dominant_channel"), F.when(second > 0, ratio).alias("ratio"))


def dominant_order(amplitudes: DataFrame) -> DataFrame:
    """The order of the greatest amplitude per signal (ties: the lower order)."""
    return amplitudes.where("order >= 1").groupBy("signal_id").agg(F.max_by("order", F.struct("amplitude", -F.col("order"))).alias("observed_order"))


def cross_check(orders: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every pattern (pattern_no, fault, direction, dominant_order) whose dominant order is the observed one (signal_id, observed_order)."""
    return orders.join(F.broadcast(patterns), F.col("observed_order") == F.col("dominant_order")).drop("dominant_order")  # six rows


def band_filter(machines: DataFrame, filters: DataFrame) -> DataFrame:
    """machines (machine_id, rpm > 0) with the envelope filter whose speed range holds rpm (lowest number first), else the nearest range."""
    ranges = filters.select("filter_no", parse_range(F.col("band")).alias("band"), parse_range(F.col("speed")).alias("speed"))
    far = F.greatest(F.lit(0.0), F.col("speed.lo") - F.col("rpm"), F.when(F.col("speed.hi") == float("inf"), 0.0).otherwise(F.col("rpm") - F.col("speed.hi")))
    # four rows are broadcast; the best is a partial aggregate
    every = machines.where("rpm > 0").join(F.broadcast(ranges), F.lit(True)).withColumn("far", far)
    return every.groupBy("machine_id", "rpm").agg(F.min_by(F.struct("filter_no", "band"), F.struct("far", "filter_no")).alias("b")).select("machine_id", "rpm", "b.filter_no", F.col("b.band.lo").alias("band_lo"), F.col("b.band.hi").alias("band_hi"))


def reciprocating_frequencies(machines: DataFrame, table: DataFrame) -> DataFrame:
    """The table's frequencies for each machine (machine_id, rpm, cylinders, strokes): a row per machine, description and multiple.

    A row that refers to another ('Same as power pulses') takes that row's text.
    """
    rows = table.select("row_no", clean(F.col("description")).alias("description"), clean(F.col("frequency")).alias("frequency"))
    other = rows.select(F.lower("description").alias("name"), F.col("frequency").alias("other"))
    named = F.lower(F.regexp_extract("frequency", "^Same as (.*)$", 1))
    text = rows.join(other, named == F.col("name"), "left").select("row_no", "description", F.coalesce("other", "frequency").alias("frequency"))
    # the texts are read once each, before they meet the machines
    read = text.select("row_no", "description", multipliers(F.col("frequency")).alias("fixed"), *(stroke_multiplier(F.col("frequency"), k).alias(f"stroke{k}") for k in (2, 4)))
    each = machines.join(F.broadcast(read), F.lit(True))
    stroke = F.when(F.col("strokes") == 4, F.col("stroke4")).otherwise(F.col("stroke2"))
    factor = F.when(stroke == "N", F.col("cylinders").cast("double")).when(stroke == "N/2", F.col("cylinders") / 2).otherwise(stroke.try_cast("double"))
    factors = F.when(stroke.isNotNull(), F.array(factor)).otherwise(F.col("fixed"))
    return each.select("machine_id", "row_no", "description", F.explode(factors).alias("multiple"), (F.col("rpm") / 60).alias("fr")).withColumn("hz", F.col("multiple") * F.col("fr"))


def reciprocating_diagnosis(frequencies: DataFrame, peaks: DataFrame, mechanisms: DataFrame, allowed: float = 2.0) -> DataFrame:
    """Each mechanism of each machine with the nearest peak within `allowed` Hz of its frequency, its cause and remedy.

    frequencies: machine_id, row_no, multiple, hz. peaks: machine_id, f, amplitude. severity is the amplitude over the
    median positive one of the machine, 0 where nothing matches. A frequency that isn't below the machine's last peak has no target.
    Mechanisms of one frequency share a peak: the spectrum alone doesn't tell them apart.
    """
    named = frequencies.join(F.broadcast(mechanisms), "row_no").where("at_multiple is null or at_multiple = multiple")  # eight rows
    lines = peaks.groupBy("machine_id").agg(F.max("f").alias("last"), F.median(F.when(F.col("amplitude") > 0, F.col("amplitude"))).alias("baseline"))
    target = F.when(F.col("hz") < F.col("last"), F.col("hz"))
    targets = named.join(lines, "machine_id", "left").select("machine_id", F.col("mechanism").alias("fault"), F.lit(1).alias("harmonic"), target.alias("target"), "baseline", "cause", "remedy")
    m = nearest_match(targets, peaks, ["machine_id"], F.lit(allowed))
    return m.select("machine_id", F.col("fault").alias("mechanism"), F.col("found").isNotNull().alias("matched"), "target", "found", F.coalesce(F.col("amplitude") / F.col("baseline"), F.lit(0.0)).alias("severity"), "cause", "remedy")
