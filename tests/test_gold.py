"""Gold sets and metrics at three levels, by hand."""

from __future__ import annotations

import json
import math

import pytest

from resona.sources import gold


def write(tmp_path, items):
    (tmp_path / "gold.json").write_text(json.dumps(items), "utf-8")
    return str(tmp_path / "gold.json")


def test_levels_are_derived(spark, tmp_path):
    items = [
        {"_id": "1", "question": "a", "expected_chunk_ids": ["p1", "p1_child_0"], "expected_visual_chunk_ids": ["v"]},
        {"id": "2", "question": "b", "expected_chunk_ids": ["p2"], "extra": 1},
        {"id": "3", "question": "c", "expected_chunk_ids": ["p3"], "expected_child_chunk_ids": ["x_child_1"], "expected_parent_chunk_ids": ["p9"]},
        {"id": "4", "question": "d"},
    ]
    got = {r.id: (r.child, r.parent, r.visual) for r in gold.load(spark, write(tmp_path, items)).collect()}
    assert got == {"1": (["p1_child_0"], ["p1"], ["v"]), "2": (["p2"], ["p2"], []), "3": (["x_child_1"], ["p9"], []), "4": ([], [], [])}


@pytest.mark.parametrize("bad", [{"question": "no id"}, {"id": "1"}, {"id": "1", "question": "q", "expected_chunk_ids": "x"}])
def test_bad_items_fail(spark, tmp_path, bad):
    with pytest.raises(Exception, match="gold item|MALFORMED|FAILFAST|Malformed"):
        gold.load(spark, write(tmp_path, [{"id": "0", "question": "fine"}, bad])).collect()


def test_metrics(spark):
    want = spark.createDataFrame([("q", ["c1", "c2", "c2"], ["p1"], [])], "id string, child array<string>, parent array<string>, visual array<string>")
    rows = [("q", "child", "x", 1), ("q", "child", "c2", 2), ("q", "child", "c1", 4), ("q", "parent", "p1", 1), ("q", "visual", "v", 1)]
    results = spark.createDataFrame(rows, "query_id string, level string, id string, rank int")
    got = {r.level: tuple(r)[2:] for r in gold.level_metrics(results, want, {"child": 3, "parent": 3, "visual": 1}).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got["child"] == pytest.approx((0.5, 0.5, 1.0, 0.5, (1 / math.log2(3)) / ideal))
    assert got["parent"] == (1.0, 1.0, 1.0, 1.0, 1.0) and got["visual"] == (0.0, 0.0, 0.0, 0.0, 0.0)
