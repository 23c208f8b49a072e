"""Titles of tables, from the text around them, and pages that name a table but have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reach above and below a table in points, the captions, and the longest piece of text that stands in for one.
ABOVE, BELOW, SHORT = 60.0, 80.0, 100
TABLE = r"Table\s+\d+\.\d+[^\n]*"
CAPTION = r"(?:Table|Figure)\s+\d+\.\d+[^\n]*"
NAMED = r"Table\s+\d+\.\d+\s+[A-Z]"
NONE = "(başlık bulunamadı)"


def _cells(lo: Column, hi: Column, size: float) -> Column:
    """Numbers of the rows of a grid that a span of heights touches."""
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def table_titles(tables: DataFrame, blocks: DataFrame, size: float = ABOVE + BELOW) -> DataFrame:
    """page, table_no, title, source (above, below, text above, text below, none) for each table.

    tables: page, table_no, x0, y0, x1, y1, height (of the page). blocks: page, x0, y0, x1, y1, text. A block counts as above (or
    below) if it overlaps the table's width and the strip of 60 points over it (of 80 under it, within the page). Of the texts of
    each strip, in order of height and then from the left, the first 'Table 1.2 ..' above is the title, else the first 'Table 1.2'
    or 'Figure 1.2' below, else the first 100 characters above, else below. Blocks and strips meet in rows of a grid of `size` points, so
    a page's tables aren't compared with all its blocks; blocks without text count for nothing.
    """
    strips = F.array(F.struct(F.lit("above").alias("side"), F.greatest(F.lit(0.0), F.col("y0") - ABOVE).alias("lo"), F.col("y0").alias("hi")), F.struct(F.lit("below").alias("side"), F.col("y1").alias("lo"), F.least("height", F.col("y1") + BELOW).alias("hi")))
    wanted = tables.select("page", "table_no", F.col("x0").alias("left"), F.col("x1").alias("right"), F.inline(strips)).where("lo < hi")
    at = wanted.withColumn("cell", F.explode(_cells(F.col("lo"), F.col("hi"), size)))
    held = blocks.where("trim(text) <> ''").select("page", "x0", "y0", "x1", "y1", "text", F.explode(_cells(F.col("y0"), F.col("y1"), size)).alias("cell"))
    inside = at.join(held, ["page", "cell"]).where("x0 < right and x1 > left and y0 < hi and y1 > lo")
    # a pair that meets in two cells is taken in the first of both spans only
    once = inside.where(F.col("cell") == F.greatest(F.floor(F.col("lo") / size), F.floor(F.col("y0") / size)))
    texts = once.groupBy("page", "table_no", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda b: b["text"]), "\n").alias("text"))
    both = texts.groupBy("page", "table_no").agg(*(F.trim(F.coalesce(F.max(F.when(F.col("side") == s, F.col("text"))), F.lit(""))).alias(s) for s in ("above", "below")))
    first = F.trim(F.regexp_extract("above", TABLE, 0)), F.trim(F.regexp_extract("below", CAPTION, 0)), F.substring("above", 1, SHORT), F.substring("below", 1, SHORT)
    title, source = F.lit(NONE), F.lit("none")
    for text, name in reversed([*zip(first, ("above", "below", "text above", "text below"), strict=True)]):
        title, source = F.when(text != "", text).otherwise(title), F.when(text != "", name).otherwise(source)
    found = both.select("page", "table_no", title.alias("title"), source.alias("source"))
    return tables.select("page", "table_no").join(found, ["page", "table_no"], "left").select("page", "table_no", F.coalesce("title", F.lit(NONE)).alias("title"), F.coalesce("source", F.lit("none")).alias("source"))


def missing_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages (page, text) whose text names a table ('Table 1.2 Word') though no table was found on them."""
    return pages.where(F.col("text").rlike(NAMED)).join(tables.select("page").distinct(), "page", "left_anti").select("page")
