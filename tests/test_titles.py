"""Titles of tables against a scan of all blocks."""

from __future__ import annotations

import random
import re

from resona.operators import titles


def plain(table, blocks):
    page, no, x0, y0, x1, y1, height = table

    def text(lo, hi):
        return "\n".join(t for _, _, t in sorted((b[2], b[1], b[5]) for b in blocks if b[0] == page and b[5] and b[5].strip() and b[1] < x1 and b[3] > x0 and b[2] < hi and b[4] > lo)).strip(" ")

    above, below = text(max(0, y0 - 60), y0), text(y1, min(height, y1 + 80)) if y1 < height else ""
    if m := re.search(titles.TABLE, above):
        return page, no, m[0].strip(), "above"
    if m := re.search(titles.CAPTION, below):
        return page, no, m[0].strip(), "below"
    if above:
        return page, no, above[:100], "text above"
    return (page, no, below[:100], "text below") if below else (page, no, titles.NONE, "none")


def test_titles(spark):
    rng = random.Random(4)
    says = ["Table 4.1 Faults", "see Table 3.2 and more", "Figure 2.5 Spectrum", "plain words " * 20, "Table four", " ", None, "Table  12.10\tWide"]
    blocks = []
    for _ in range(150):
        x, y = rng.randint(0, 500), rng.randint(0, 780)
        blocks.append((rng.randint(1, 12), float(x), float(y), x + rng.randint(5, 200) * 1.0, y + rng.randint(3, 200) * 1.0, rng.choice(says)))
    tables = [(p, k, float(x := rng.randint(0, 400)), float(y := rng.randint(0, 700)), x + 150.0, y + rng.randint(20, 140) * 1.0, 800.0) for p in range(1, 14) for k in range(4)]
    b = spark.createDataFrame(blocks, "page int, x0 double, y0 double, x1 double, y1 double, text string")
    t = spark.createDataFrame(tables, "page int, table_no int, x0 double, y0 double, x1 double, y1 double, height double")
    got = sorted(tuple(r) for r in titles.table_titles(t, b).collect())
    assert got == sorted(plain(x, blocks) for x in tables)
    assert {g[3] for g in got} == {"above", "below", "text above", "text below", "none"}


def test_missing_tables(spark):
    pages = spark.createDataFrame([(1, "Table 1.1 Faults"), (2, "Table 1.1 faults"), (3, "see Table 2.10\nNext"), (4, None), (5, "Table 1.1 X")], "page int, text string")
    found = spark.createDataFrame([(5, 1), (5, 2)], "page int, table_no int")
    assert sorted(r.page for r in titles.missing_tables(pages, found).collect()) == [1, 3]
