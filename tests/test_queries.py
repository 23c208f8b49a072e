"""Each query against its SQL twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from resona import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    result = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(str(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert sorted(tuple(str(r[c]) for c in order) for r in got) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_plans(spark, sf_dir):
    q = catalogue.QUERIES
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan(q["sig_time_stats"](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" in plan(q["sig_severity_zone"](spark, sf_dir)) or "BroadcastHashJoin" in plan(q["sig_severity_zone"](spark, sf_dir))
    assert "WindowGroupLimit" in plan(q["dense_topk"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in plan(q["parent_merge"](spark, sf_dir))
    for name in ("sig_time_stats", "harmonic_match", "sparse_bm25_topk", "section_islands", "threshold_grid"):
        assert "Python" not in plan(q[name](spark, sf_dir))
