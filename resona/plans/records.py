"""Queries that render, name, route and join records, and tables ready for plotting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from resona.functions import records as rec
from resona.operators import kernels
from resona.operators import signals as op
from resona.plans.text import CELLS, DENSE, _dense
from resona.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{rec.DNS}') || encode('doc_parent_' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", rec.uuid5(F.concat(F.lit("doc_parent_"), F.col("doc_id"))).alias("point_id"))


@query(f"""WITH {CELLS} SELECT page_id, md5('| ' || array_to_string(rows[1], ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(rows[1], lambda x: '---'), ' | ') || ' |' || chr(10)
  || array_to_string(list_transform(rows[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10))) AS markdown FROM c WHERE len(rows) > 1""")
def table_markdown(spark, d):
    rows = F.transform(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1)), lambda x: F.split(F.regexp_replace(x, "<[^>]*>", ""), "/"))
    t = table(spark, d, "pages").select("page_id", rows.alias("rows")).where("size(rows) > 1")
    return t.select("page_id", F.md5(rec.markdown(F.col("rows")[0], F.slice("rows", F.lit(2), F.size("rows"))).cast("binary")).alias("markdown"))


@query("""WITH s AS (SELECT doc_id, quality * ((doc_id % 11) / 10.0::DOUBLE) AS s FROM labels) SELECT doc_id, CASE WHEN s >= 0.8 THEN 5 WHEN s >= 0.6 THEN 4 WHEN s >= 0.4 THEN 3 WHEN s > 0 THEN 2 ELSE 1 END AS stars FROM s""")
def star_rating(spark, d):
    return table(spark, d, "labels").select("doc_id", rec.stars(F.col("quality") * (F.col("doc_id") % 11 / 10.0)).alias("stars"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND role = 'user' THEN 'hybrid' WHEN conv_id % 2 = 0 THEN 'signal_only' WHEN role = 'user' THEN 'rag_only' ELSE 'error' END AS route,
  CASE WHEN turn % 2 = 0 THEN 'reciprocating' ELSE 'rotating' END AS machine FROM conversations""")
def input_route(spark, d):
    c = table(spark, d, "conversations")
    machine = F.when(F.col("turn") % 4 == 0, "Piston pump").when(F.col("turn") % 2 == 0, "a reciprocating one").when(F.col("turn") % 3 == 0, "fan")
    return c.select("conv_id", "turn", rec.input_route(F.col("conv_id") % 2 == 0, F.when(F.col("role") == "user", F.lit("what"))).alias("route"), rec.machine_route(machine).alias("machine"))


@query(f"""WITH {DENSE}, k AS (SELECT query_id, id, score FROM r WHERE rank <= 10), x AS (SELECT DISTINCT id FROM k WHERE score < 0.25) SELECT query_id, id FROM k WHERE id NOT IN (SELECT id FROM x)""")
def excluded_chunks(spark, d):
    hits = _dense(spark, d, 10)
    return hits.join(hits.where("score < 0.25").select("id").distinct(), "id", "left_anti").select("query_id", "id")


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS page, l_partkey AS image FROM lineitem) SELECT page, image, CAST(row_number() OVER (PARTITION BY page ORDER BY image) - 1 AS INTEGER) AS idx FROM u""")
def figure_index(spark, d):
    seen = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("image")).dropDuplicates()
    return seen.withColumn("idx", F.row_number().over(Window.partitionBy("page").orderBy("image")) - 1)


@query(f"WITH {DENSE}, p AS (SELECT query_id, id % 40 AS parent, min(rank) AS first FROM r WHERE rank <= 25 GROUP BY ALL) SELECT query_id, parent, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS place FROM p")
def distinct_parents(spark, d):
    p = _dense(spark, d, 25).groupBy("query_id", (F.col("id") % 40).alias("parent")).agg(F.min("rank").alias("first"))
    return p.select("query_id", "parent", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("place"))


SCENARIOS = {"clean": "approved", "dsp_mismatch": "retry_generation", "unfaithful": "retry_retrieval", "sub_query_gap": "retry_retrieval"}


@query(f"""WITH s(scenario, expected) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in SCENARIOS.items())})
SELECT item_id || '_' || scenario AS id, scenario, expected, CASE scenario WHEN 'sub_query_gap' THEN substr(text, 1, length(text) // 2) WHEN 'unfaithful' THEN upper(substr(text, 1, 0)) ELSE text END AS response FROM benchmark, s""")
def scenario_benchmark(spark, d):
    kinds = F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("expected")) for k, v in SCENARIOS.items()))
    b = table(spark, d, "benchmark").select("item_id", "text", F.inline(kinds))
    response = F.when(F.col("scenario") == "sub_query_gap", F.expr("substring(text, 1, cast(length(text) div 2 as int))")).when(F.col("scenario") == "unfaithful", "").otherwise(F.col("text"))
    return b.select(F.concat_ws("_", "item_id", "scenario").alias("id"), "scenario", "expected", response.alias("response"))


@query("""SELECT d.doc_id, coalesce(CASE WHEN isnan(s) THEN NULL ELSE s END, 0) AS score FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN 'nan'::DOUBLE ELSE (doc_id % 10) / 10.0::DOUBLE END AS s FROM labels) l USING (doc_id)""")
def judge_scores(spark, d):
    s = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, float("nan")).otherwise(F.col("doc_id") % 10 / 10.0).alias("s"))
    return table(spark, d, "documents").select("doc_id").join(s, "doc_id", "left").select("doc_id", F.coalesce(F.nanvl("s", F.lit(None).cast("double")), F.lit(0.0)).alias("score"))


@query()
def kurtogram_grid(spark, d):
    """Kurtograms as a rectangle: a band of level l covers its share of the finest level's columns; missing bands are 0."""
    k = kernels.kurtograms(op.samples(table(spark, d, "events")), 1000.0)
    cells = k.select("signal_id", "channel", "level", F.col("kurtosis"), F.explode(F.expr("sequence(cast(band * pow(2, 5 - level) as int), cast((band + 1) * pow(2, 5 - level) - 1 as int))")).alias("column"))
    return cells.groupBy("signal_id", "channel", "level").agg(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda c: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.struct("column", "kurtosis"))), c), F.lit(0.0))).alias("row")).select("signal_id", "channel", "level", F.round(F.aggregate("row", F.lit(0.0), lambda a, v: a + v), 6).alias("row_sum"))


@query()
def orbit_points(spark, d):
    """Shaft orbit of each channel (quadrature), six revolutions after the first two."""

    def each(frames):
        for pdf in frames:
            rows = []
            for s, c, xs in zip(pdf["signal_id"], pdf["channel"], pdf["xs"], strict=True):
                a, b = kernels.orbit(xs, None, 1000.0, 300.0) if len(xs) >= 8 else ((), ())
                rows += [(s, c, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
            yield pd.DataFrame(rows, columns=["signal_id", "channel", "i", "x", "y"])

    return kernels.packed(op.samples(table(spark, d, "events"))).mapInPandas(each, "signal_id long, channel string, i long, x double, y double")
