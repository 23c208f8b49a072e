"""Reference dimensions and schemas of the condition-monitoring domain.

The rule tables (severity zones, envelope filters, reciprocating table, spectral patterns) are those of resona/rules, read by
sources.rules; their plain forms here serve the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resona.sources import rules

SAMPLES = "signal_id long, channel string, i long, x double"

_TABLES, _PATTERNS = rules.chunks_of("tables.json"), rules.chunks_of("patterns.json")
_CHART = _TABLES["fig_p15_0"]["structured_data"]
#: class, zone, lo, hi of the severity zones, half-open; the last zone is open.
SEVERITY = [(g["name"], zone, b["min_mm_s"] or 0.0, b["max_mm_s"]) for g in _CHART["groups"] for zone, b in g["zones"].items()]
ZONE_MEANINGS = _CHART["zone_meanings"]
#: row, multiple (where a row has a mechanism for each), name, cause, remedy.
MECHANISMS = [(int(r), None if o is None else float(o), *rest) for r, o, *rest in _TABLES["mechanisms"]["rows"]]


def severity(spark: SparkSession) -> DataFrame:
    """class, zone, lo, hi, meaning; an open end is null."""
    return rules.severity(rules.chunks(spark))


def filters(spark: SparkSession) -> DataFrame:
    return rules.filters(rules.chunks(spark))


def reciprocating(spark: SparkSession) -> DataFrame:
    return rules.reciprocating(rules.chunks(spark))


def mechanisms(spark: SparkSession) -> DataFrame:
    return rules.mechanisms(rules.chunks(spark))


def patterns(spark: SparkSession) -> DataFrame:
    """pattern_no, fault, direction, dominant_order of the patterns of the faults that the ratio rules cover."""
    return rules.patterns(rules.chunks(spark, package="patterns.json")).select("pattern_no", "fault", "direction", "dominant_order")
