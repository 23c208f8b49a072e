"""Rule files as rows, and what can't be read of them."""

from __future__ import annotations

import json

from resona import schemas
from resona.sources import rules


def test_package_rules(spark):
    zones = {(r["class"], r.zone): (r.lo, r.hi, r.meaning) for r in schemas.severity(spark).collect()}
    assert len(zones) == 16 and zones["Class II", "C"] == (2.8, 7.1, "Just Tolerable") and zones["Class IV", "D"] == (18.0, None, "Not Permissible")
    assert [tuple(r)[:2] for r in schemas.filters(spark).collect()] == [(1, "5 – 100 Hz"), (2, "50 – 1,000 Hz"), (3, "500 – 10,000 Hz"), (4, "5,000 – 40,000 Hz")]
    assert len(schemas.reciprocating(spark).collect()) == 7 and len(schemas.mechanisms(spark).collect()) == 8
    assert [(r.order_no, r.phase) for r in rules.phases(rules.chunks(spark)).collect()] == [(1.0, 87.0), (2.0, 123.0), (3.0, 165.0)]
    want = [("unbalance", 1.0), ("angular_misalignment", 1.0), ("parallel_misalignment", 2.0), ("mechanical_looseness_internal", 2.0), ("mechanical_looseness", 2.0), ("mechanical_looseness", 2.0)]
    assert [(r.fault, r.dominant_order) for r in sorted(schemas.patterns(spark).collect())] == want


def test_files_and_dead_letters(spark, tmp_path):
    peaks = [{"order": "0.5x", "relative_amplitude": "moderate"}, {"order": "3X", "relative_amplitude": "odd"}, {"order": "1.5 X", "relative_amplitude": "moderate"}]
    good = [
        {"chunk_id": "a", "content_type": "spectrum", "structured_data": {"fault_type": "unbalance", "direction": 5, "peaks": peaks}},
        {"chunk_id": "b", "content_type": "spectrum", "structured_data": {"fault_type": "bent_shaft", "peaks": peaks}},
        {"chunk_id": "c", "content_type": "spectrum", "structured_data": {"fault_type": "unbalance", "peaks": []}},
        {"chunk_id": "d", "content_type": "spectrum", "structured_data": {"fault_type": "unbalance", "peaks": "none"}},
        {"chunk_id": "e", "content_type": "spectrum", "structured_data": {"fault_type": "mechanical_looseness", "peaks": [{"order": "harmonics", "relative_amplitude": "dominant"}]}},
        {"chunk_id": "table_p29_vision", "content_type": "table", "page_number": "x", "rows": [["7", "1 – 2 Hz", None]]},
    ]
    bad = [{"content_type": "table"}, {"chunk_id": "a", "content_type": "text"}, {"chunk_id": "f", "content_type": "table", "rows": 3}, 4]
    (tmp_path / "good.json").write_text(json.dumps(good + bad), "utf-8")
    (tmp_path / "cut.json").write_text("[{", "utf-8")
    (tmp_path / "other.json").write_text('{"chunk_id": "no array"}', "utf-8")
    (tmp_path / "empty.json").write_text("[]", "utf-8")
    found = rules.chunks(spark, str(tmp_path)).collect()
    assert sorted(r.problem for r in found if r.problem) == ["no chunk_id", "no chunk_id", "no rows", "not JSON", "not JSON", "not JSON", "repeated"]
    assert len(found) == len(good) + 7 and {r.raw for r in found if r.problem == "not JSON"} == {"[{", '{"chunk_id": "no array"}', "[]"}
    assert json.loads(next(r.raw for r in found if r.problem == "no rows")) == bad[2]
    rows = rules.chunks(spark, str(tmp_path))
    assert [(r.chunk_id, r.dominant_order, r.n_peaks) for r in rules.patterns(rows).collect()] == [("a", 0.5, 3), ("e", None, 1)]
    assert [tuple(r) for r in rules.filters(rows).collect()] == [(7, "1 – 2 Hz", None, None)]
