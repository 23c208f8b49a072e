"""Text and table ingestion: sections, islands, chunks, table filters, routing, document store."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Caption keywords, in order of priority, and the rules for reviews.
ROUTES = {
    "severity": ["severity", "iso 10816", "iso10816", "vdi 2056", "vdi2056", "ird mechanalysis"],
    "bearing_stage": ["bearing defect", "stage 1", "stage 2", "stage 3", "stage 4", "hfd", "zone a", "zone b", "zone c", "zone d"],
    "orbit": ["orbit", "lissajous"],
    "spectrum": ["fft", "spectrum", "waveform", "bode", "nyquist", "cepstrum", "waterfall", "spectrogram", "envelope", "phase relationship", "phase relation"],
}
SKIPPED_CAPTIONS = ["equipment", "photograph", "courtesy", "logo", "photo of", "installed", "mounting", "accessories"]
DIAGRAM_WORDS = ["1st cycle", "2nd cycle", "1 rev", "rigid shaft", "flexible shaft", "schematic", "schematic diagram", "pinned at this point"]
ORBIT_FAULTS = {
    "inner_loop": ["rub", "hit_and_bounce", "rubbing"],
    "circular": ["none", "normal", "healthy", "unbalance"],
    "elliptical": ["unbalance", "misalignment", "resonance", "bearing_wear"],
    "banana_shape": ["misalignment"],
    "figure_eight": ["misalignment"],
    "multiple_loops": ["looseness", "mechanical_looseness"],
}
INGESTED = ["spectrum", "severity_chart", "bearing_stage", "orbit_plot", "diagram"]
NOT_INGESTED = ["equipment_photo", "decorative", "schematic_generic", "logo"]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, text of each line of a text."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))


def section_of(blocks: DataFrame, is_heading: Column, by: str = "doc_id", order: str = "line") -> DataFrame:
    """Backward as-of: each block with the last heading at or before it in its document ('unknown' before the first)."""
    w = Window.partitionBy(by).orderBy(order)
    return blocks.withColumn("section", F.coalesce(F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(w), F.lit("unknown")))


def islands(rows: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """Runs of consecutive rows of equal key: by, island (from 1), key, n, first and last of the first order column."""
    w = Window.partitionBy(by).orderBy(*order)
    change = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)), 0).otherwise(1)
    marked = rows.withColumn("change", change).withColumn("island", F.sum("change").over(w))
    return marked.groupBy(by, "island").agg(F.first(key).alias(key), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def merge_small(groups: DataFrame, by: str, order: str, size: str, least: int = 150) -> DataFrame:
    """Sequential fold per `by`: a group under `least` takes in the next ones until it is large enough; by, part, n_groups, size."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(size).cast("long").alias("size")))), lambda s: s["size"])
    start = F.struct(F.array().cast("array<struct<n_groups:int,size:bigint>>").alias("done"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"))

    def step(a: Column, v: Column) -> Column:
        n, total = a["n"] + 1, a["size"] + v
        full = total >= least
        return F.struct(F.when(full, F.concat(a["done"], F.array(F.struct(n.alias("n_groups"), total.alias("size"))))).otherwise(a["done"]).alias("done"), F.when(full, 0).otherwise(n).alias("n"), F.when(full, F.lit(0).cast("long")).otherwise(total).alias("size"))

    end = lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(F.struct(a["n"].alias("n_groups"), a["size"].alias("size"))))).otherwise(a["done"])
    return groups.groupBy(by).agg(items.alias("items")).select(by, F.posexplode(F.aggregate("items", start, step, end)).alias("part", "g")).select(by, "part", "g.n_groups", "g.size")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def table_quality(rows: Column) -> Column:
    """Struct of cells, filled, ghost (too few or too empty cells) and reliable (even rows, filled header) of an array of rows."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    n = F.size(cells)
    ghost = (n < 4) | (filled < 3) | (filled / n < 0.35) | (F.size(rows) < 2)
    head = F.try_element_at(rows, F.lit(1))
    even = F.forall(rows, lambda r: F.size(r) == F.size(head))
    named = F.size(F.filter(head, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) >= 0.5 * F.size(head)
    nulls = F.size(F.filter(cells, lambda c: c.isNull())) / n
    return F.struct(n.alias("cells"), filled.alias("filled"), ghost.alias("ghost"), (even & named & (filled >= 4) & (nulls <= 0.5)).alias("reliable"))


def merge_pages(tables: DataFrame, by: str, page: str, width: str, titled: str) -> DataFrame:
    """Tables that go on on the next page (page + 1, same width, no title of its own) join in pairs, first come first.

    In a run of n such steps every second one takes effect, so the parity of the place in the run decides.
    """
    w = Window.partitionBy(by).orderBy(page)
    goes_on = (F.lag(page).over(w) == F.col(page) - 1) & (F.lag(width).over(w) == F.col(width)) & ~F.col(titled)
    marked = tables.withColumn("on", F.coalesce(goes_on, F.lit(False)))
    run = marked.withColumn("run", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w))
    place = run.withColumn("place", F.row_number().over(Window.partitionBy(by, "run").orderBy(page)) - 1)
    return place.withColumn("merged", F.col("place") % 2 == 1).drop("on")


def any_of(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w).replace("\\ ", " ") for w in words))


def route(caption: Column) -> Column:
    """The first kind whose keywords the caption holds, else unified."""
    out = F
    for name, words in ROUTES.items():
        out = out.when(any_of(caption, words), name)
    return out.otherwise("unified")


def skip(caption: Column, size: Column) -> Column:
    """Whether a captioned image isn't worth captioning."""
    return (F.coalesce(caption, F.lit("")) != "") & (any_of(caption, SKIPPED_CAPTIONS) | (size < 5000))


def worth_ingesting(kind: Column, description: Column) -> Column:
    return F.when(kind.isin(INGESTED), True).when(kind.isin(NOT_INGESTED), False).otherwise(F.length(F.coalesce(description, F.lit(""))) > 50)


def needs_review(fault: Column, caption: Column, orbit: Column, text: Column, kind: Column) -> Column:
    """Fault not named in the caption, orbit shape that doesn't go with the fault, or a spectrum that describes a diagram."""
    terms = F.filter(F.split(F.translate(F.lower(fault), "_", " "), " "), lambda t: F.length(t) > 3)
    named = F.coalesce((fault == "") | (caption == "") | (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(F.lower(caption), t)), F.lit(True))
    allowed = F.create_map(*(x for k, v in ORBIT_FAULTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    shape = F.try_element_at(allowed, F.translate(F.lower(orbit), " ", "_"))
    odd = F.coalesce(~F.array_contains(shape, F.translate(F.lower(fault), " ", "_")), F.lit(False))
    leak = (kind == "spectrum") & any_of(text, DIAGRAM_WORDS)
    return ~named | odd | F.coalesce(leak, F.lit(False))


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: the row of the highest version of each key, by partial aggregation."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def masked(blocks: DataFrame, boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Blocks (page, x0, y0, x1, y1) without those of which a box on the page covers at least the share."""
    b, m = blocks.alias("b"), boxes.alias("m")
    over = F.greatest(F.lit(0.0), F.least("b.x1", "m.x1") - F.greatest("b.x0", "m.x0")) * F.greatest(F.lit(0.0), F.least("b.y1", "m.y1") - F.greatest("b.y0", "m.y0"))
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    return b.join(m, (F.col("b.page") == F.col("m.page")) & (over >= share * area), "left_anti")
