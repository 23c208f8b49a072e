"""Rules as rows (the files of resona/rules are fixed values): nested JSON chunks (tables, charts, patterns) from files that Spark reads, or from those of the package.

A file is a JSON array of chunks. Each becomes a row with typed columns; what differs from kind to kind (structured_data) stays
a VARIANT and is read by path where it is needed. A file or chunk that can't be read is a row with a problem, its text kept.
"""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions.signal import clean

CHUNK = {"chunk_id": "string", "content_type": "string", "page_number": "int", "table_title": "string", "headers": "array<string>", "rows": "array<array<string>>", "structured_data": "variant", "confidence": "string"}
# The fault types that the ratio rules cover, and how high a pattern's amplitudes rank.
RELEVANT = ("unbalance", "angular_misalignment", "parallel_misalignment", "mechanical_looseness", "mechanical_looseness_internal")
RANK = {"dominant": 3, "moderate": 2, "low": 1}


def text_of(name: str) -> str:
    """A rule file of the package."""
    return (resources.files("resona") / "rules" / name).read_text("utf-8")


def chunks_of(name: str) -> dict[str, dict]:
    """Chunks of a rule file of the package by id, for SQL twins."""
    return {c["chunk_id"]: c for c in json.loads(text_of(name))}


def chunks(spark: SparkSession, path: str | None = None, package: str = "tables.json") -> DataFrame:
    """path, pos, the columns of CHUNK, problem and raw for each chunk of the files at path, or of the package's file.

    problem is null, or 'not JSON' (the file), 'no chunk_id', 'repeated' (of an id that came before in its file) or 'no rows' (a
    table without them); raw is the text of what has a problem. Fields of another type than CHUNK's are null.
    """
    if path is None:
        files = spark.range(1).select(F.lit(package).alias("path"), F.lit(text_of(package)).alias("value"))
    else:
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    whole = files.select("path", "value", F.try_parse_json("value").alias("v"))
    each = F.try_variant_get("v", "$", "array<variant>")
    rows = whole.select("path", "value", F.posexplode_outer(F.transform(each, lambda c: F.struct(c.alias("c")))).alias("pos", "e"))
    got = rows.select("path", "pos", "value", F.col("e.c").alias("c")).select("path", "pos", "value", "c", *(F.try_variant_get("c", f"$.{k}", kind).alias(k) for k, kind in CHUNK.items()))
    before = F.min("pos").over(_same())
    problem = F.when(F.col("pos").isNull(), "not JSON").when(F.col("chunk_id").isNull(), "no chunk_id").when(F.col("pos") > before, "repeated").when((F.col("content_type") == "table") & F.col("rows").isNull(), "no rows")
    raw = F.when(F.col("problem").isNotNull(), F.coalesce(F.to_json("c"), F.col("value")))
    return got.withColumn("problem", problem).withColumn("raw", raw).select("path", "pos", *CHUNK, "problem", "raw")


def _same():
    from pyspark.sql import Window

    return Window.partitionBy("path", "chunk_id")


def _table(found: DataFrame, chunk_id: str) -> DataFrame:
    """row_no and r (an array of cells) of a table's rows."""
    return found.where((F.col("chunk_id") == chunk_id) & F.col("problem").isNull()).select(F.posexplode("rows").alias("at", "r")).select((F.col("at") + 1).alias("row_no"), "r")


def _cell(k: int) -> Column:
    return F.try_element_at("r", F.lit(k))


def severity(found: DataFrame) -> DataFrame:
    """class, zone, lo, hi, meaning; a missing lower bound is 0, an open end null."""
    groups = "array<struct<name: string, zones: map<string, struct<min_mm_s: double, max_mm_s: double>>>>"
    chart = found.where("chunk_id = 'fig_p15_0' and problem is null").select(F.variant_get("structured_data", "$.groups", groups).alias("groups"), F.variant_get("structured_data", "$.zone_meanings", "map<string, string>").alias("meanings"))
    zones = chart.select("meanings", F.inline("groups")).select("meanings", F.col("name").alias("class"), F.explode("zones").alias("zone", "z"))
    return zones.select("class", "zone", F.coalesce("z.min_mm_s", F.lit(0.0)).alias("lo"), F.col("z.max_mm_s").alias("hi"), F.try_element_at("meanings", F.col("zone")).alias("meaning"))


def filters(found: DataFrame) -> DataFrame:
    return _table(found, "table_p29_vision").select(_cell(1).cast("int").alias("filter_no"), _cell(2).alias("band"), _cell(3).alias("speed"), _cell(4).alias("analysing"))


def reciprocating(found: DataFrame) -> DataFrame:
    return _table(found, "table_p47_0+p48").select("row_no", _cell(1).alias("description"), _cell(2).alias("frequency"))


def mechanisms(found: DataFrame) -> DataFrame:
    return _table(found, "mechanisms").select(_cell(1).cast("int").alias("row_no"), _cell(2).cast("double").alias("at_multiple"), _cell(3).alias("mechanism"), _cell(4).alias("cause"), _cell(5).alias("remedy"))


def phases(found: DataFrame) -> DataFrame:
    """order_no, amplitude_1, amplitude_2, phase: a reference for reports; rows without an order are left out."""
    number = lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("double")
    return _table(found, "table_p61_0").select(order_number(_cell(1)).alias("order_no"), *(number(_cell(k)).alias(n) for k, n in ((2, "amplitude_1"), (3, "amplitude_2"), (4, "phase")))).where("order_no is not null")


def order_number(text: Column) -> Column:
    """'1.5x' as 1.5; null for other names."""
    return F.regexp_extract(F.upper(clean(text)), r"^(\d+(?:\.\d+)?)X$", 1).try_cast("double")


def patterns(found: DataFrame) -> DataFrame:
    """pattern_no, chunk_id, fault, direction, sidebands, n_peaks, dominant_order: patterns of the relevant faults that have peaks, in file order.

    The dominant order is that of the first of the peaks whose amplitude ranks highest; null where that isn't a multiple of the speed.
    """
    peaks = F.try_variant_get("structured_data", "$.peaks", "array<struct<order: string, relative_amplitude: string>>")
    of = lambda name: F.try_variant_get("structured_data", f"$.{name}", "string")
    rows = found.where("problem is null").select("path", "pos", "chunk_id", of("fault_type").alias("fault"), of("direction").alias("direction"), of("sideband_pattern").alias("sidebands"), peaks.alias("peaks"))
    kept = rows.where(F.col("fault").isin(*RELEVANT) & (F.size("peaks") > 0))
    ranks = F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))
    ranked = F.transform("peaks", lambda p, k: F.struct(F.coalesce(F.try_element_at(ranks, p["relative_amplitude"]), F.lit(0)).alias("rank"), (-k).alias("place"), p["order"].alias("order")))
    number = F.row_number().over(_in_order())
    return kept.select(number.alias("pattern_no"), "chunk_id", "fault", "direction", "sidebands", F.size("peaks").alias("n_peaks"), order_number(F.array_max(ranked)["order"]).alias("dominant_order"))


def _in_order():
    from pyspark.sql import Window

    return Window.orderBy("path", "pos")  # a few patterns
