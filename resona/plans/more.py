"""Queries on names, orders, masks, counts by kind and points for plots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from resona.functions import records as rec
from resona.operators import ingestion as ing
from resona.operators import retrieval as ret
from resona.operators import titles
from resona.plans.text import BM25, CAPTION, DENSE, NAMES, _caption_sql, _captions, _dense
from resona.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# the whole texts of the documents that stand for vectors are queries of the sparse side
HYBRID = DENSE + ", " + BM25.replace("SELECT DISTINCT item_id AS query_id, unnest(", "SELECT DISTINCT doc_id AS query_id, unnest(").replace("FROM benchmark", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)")
FUSED = HYBRID + """, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM r WHERE rank <= 15 UNION ALL SELECT query_id, id, rank FROM s WHERE rank <= 25) GROUP BY ALL
), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)"""


def _hybrid(spark, d, n):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"))
    # a hundredth of the vectors' ids
    sparse = ret.bm25_of_texts(docs, docs.join(F.broadcast(vectors), "id", "left_semi").withColumnRenamed("id", "query_id"), 25)
    return ret.fuse(_dense(spark, d, 25), sparse, n)


@query(f"WITH {FUSED} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 10")
def hybrid_search(spark, d):
    """Vectors and BM25 of the texts, fused by rank; the sparse side is favoured."""
    return _hybrid(spark, d, 10).select("query_id", "id", "score", "rank")


@query(f"""WITH {FUSED}, c AS (SELECT query_id, id, id % 40 AS parent, 1 / (1 + exp(-(300 * score - 6))) AS score FROM g WHERE rank <= 10
), y AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS best FROM c
), k AS (SELECT * FROM y WHERE CASE WHEN top >= 0.2 THEN score >= 0.2 WHEN top >= 0.1 THEN score >= 0.1 ELSE best = 1 END
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY score DESC, id) AS child FROM k
), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o WHERE child = 1)
SELECT query_id, id, parent, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 3""")
def hybrid_rerank(spark, d):
    """The fused list, scored, cut by the cascade and reduced to one child of each parent."""
    c = _hybrid(spark, d, 10).select("query_id", "id", (F.col("id") % 40).alias("parent"), (300 * F.col("score") - 6).alias("logit"))
    return ret.rerank(c, 3).select("query_id", "id", "parent", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {BM25}, w AS (SELECT DISTINCT ON (query_id) query_id, term FROM q ORDER BY query_id, length(term) DESC, term), e AS (SELECT query_id, id FROM w JOIN tf USING (term)
), h AS (SELECT e.query_id, count(*) AS wanted, count(s.id) AS found FROM e LEFT JOIN s ON s.query_id = e.query_id AND s.id = e.id AND s.rank <= 5 GROUP BY 1)
SELECT query_id, round(found * 1.0::DOUBLE / wanted, 6) AS recall FROM h""")
def visual_recall(spark, d):
    """Recall of the expected passages among the best five; expected are all that hold an item's longest term."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    counted = ret.counted_terms(docs, items.count())
    hits = ret.bm25_top_k(docs, items, 5, counted=counted).select("query_id", "id", "rank")
    longest = F.get(F.array_sort(F.transform(ret.tokens(F.col("text")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("term")))), F.lit(0))["term"]
    held = counted.select("id", F.explode("terms.term").alias("term"))
    gold = held.join(items.select("query_id", longest.alias("term")), "term").select("query_id", "id")
    return ret.ranking_metrics(hits, gold, 5).select("query_id", F.round("recall", 6).alias("recall"))


@query("""WITH c AS (SELECT doc_id, doc_id || '_parent_' || n_chars % 7 || '_child_' || n_chars % 3 AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN source END AS parent FROM documents)
SELECT doc_id, coalesce(parent, split_part(chunk_id, '_child_', 1)) AS parent_id FROM c""")
def parent_ids(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id"), F.lit("_parent_"), F.col("n_chars") % 7, F.lit("_child_"), F.col("n_chars") % 3).alias("chunk_id"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("parent"))
    return c.select("doc_id", rec.parent_id(F.col("parent"), F.col("chunk_id")).alias("parent_id"))


@query(f"""WITH {CAPTION}, y AS (SELECT CASE {' '.join(f"WHEN {_caption_sql(w)} THEN '{k}'" for k, w in ing.ROUTES.items())} ELSE 'unified' END AS kind, t <> '' AND ({_caption_sql(ing.SKIPPED_CAPTIONS)} OR bytes < 5000) AS skipped FROM x)
SELECT kind, count(*) AS n, count(*) FILTER (skipped) AS n_skipped FROM y GROUP BY 1""")
def counts_by_kind(spark, d):
    c = _captions(spark, d).select(ing.route(F.col("t")).alias("kind"), ing.skip(F.col("t"), F.col("bytes")).alias("skipped"))
    return c.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("skipped").alias("n_skipped"))


@query("""WITH s AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id AS signal_id, event_type AS channel, i, value AS x FROM s WHERE i % CAST(greatest(1, ceil(n / 20)) AS BIGINT) = 0""")
def plot_points(spark, d):
    """Every so many-th sample, so that a channel has at most about 20 points."""
    from resona.operators import signals as op

    return op.thinned(op.samples(table(spark, d, "events")), 20)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def first_json(spark, d):
    """The object of an answer that has it in a code fence, or between other words."""
    e = table(spark, d, "events")
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so ```json\n"), "props", F.lit("\n``` ok"))).otherwise(F.concat("event_type", F.lit(": "), "props", F.lit(" done.")))
    return e.select("event_id", F.variant_get(rec.first_json(answer), "$.k", "long").alias("k"))


@query("""WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_size || 'X' ELSE p_retailprice || 'x' END AS label FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(label, '[0-9]+([.][0-9]+)?[xX]') THEN CAST(rtrim(label, 'xX') AS DOUBLE) END AS order_no, md5(p_name || chr(10) || chr(10) || p_type) AS embedded, round(p_retailprice * 1.0::DOUBLE * 3, 4) AS third FROM o JOIN part USING (p_partkey)""")
def record_fields(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 3
    label = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit("X"))).otherwise(F.concat(F.col("p_retailprice").cast("string"), F.lit("x")))
    return p.select("p_partkey", rec.order_number(label).alias("order_no"), F.md5(rec.embedding_text(F.col("p_name"), F.col("p_type")).cast("binary")).alias("embedded"), F.round(rec.harmonics(F.col("p_retailprice").cast("double"), 3)[2], 4).alias("third"))


BLOCKS = """b AS (SELECT o_orderkey, o_custkey AS page, (o_orderkey * 7 % 80)::DOUBLE AS x0, (o_orderkey * 11 % 90)::DOUBLE AS y0, (o_orderkey * 7 % 80 + 10 + o_orderkey % 9)::DOUBLE AS x1, (o_orderkey * 11 % 90 + 5)::DOUBLE AS y1 FROM orders
), m AS (SELECT s_suppkey AS page, (s_suppkey * 13 % 60)::DOUBLE AS x0, (s_suppkey * 17 % 50)::DOUBLE AS y0, (s_suppkey * 13 % 60 + 40)::DOUBLE AS x1, (s_suppkey * 17 % 50 + 40)::DOUBLE AS y1 FROM supplier)"""


@query(f"""WITH {BLOCKS} SELECT o_orderkey FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page = b.page AND greatest(0, least(b.x1, m.x1) - greatest(b.x0, m.x0)) * greatest(0, least(b.y1, m.y1) - greatest(b.y0, m.y0)) >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0))""")
def masked_blocks(spark, d):
    """Blocks of a page that no table covers by half."""
    o, s = F.col("o_orderkey"), F.col("s_suppkey")
    box = lambda x, y, w, h: [c.cast("double").alias(n) for c, n in ((x, "x0"), (y, "y0"), (x + w, "x1"), (y + h, "y1"))]
    blocks = table(spark, d, "orders").select(o, F.col("o_custkey").alias("page"), *box(o * 7 % 80, o * 11 % 90, 10 + o % 9, F.lit(5)))
    boxes = table(spark, d, "supplier").select(s.alias("page"), *box(s * 13 % 60, s * 17 % 50, F.lit(40), F.lit(40)))
    return ing.masked(blocks, boxes).select("o_orderkey")


PAIRS = [("view", "click"), ("error", "view"), ("click", "purchase"), ("purchase", "error")]


@query(f"""WITH p(priority, a, b) AS (VALUES {', '.join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(PAIRS))}), c AS (SELECT DISTINCT user_id, upper(event_type) AS channel FROM events)
SELECT x.user_id AS signal_id, min_by(a, priority) AS x_channel, min_by(b, priority) AS y_channel FROM p JOIN c x ON x.channel = upper(a) JOIN c y ON y.user_id = x.user_id AND y.channel = upper(b) GROUP BY 1""")
def orthogonal_pairs(spark, d):
    """The first pair of channels that a signal has both of, in whatever case their names are."""
    from resona.operators import signals as op

    return op.first_pair(table(spark, d, "events").select(F.col("user_id").alias("signal_id"), F.col("event_type").alias("channel")), PAIRS)


#: Customers are pages; their orders are blocks of text, what suppliers are to masked_blocks are the tables; both on a page of 100 points' height.
CAPTIONS = "CASE o_orderkey % 5 WHEN 0 THEN 'Table ' || (o_orderkey % 9) || '.' || (o_orderkey % 7) || ' ' || o_orderpriority WHEN 1 THEN 'Figure ' || (o_orderkey % 9) || '.1 ' || o_orderpriority ELSE o_orderpriority END"
TITLES = BLOCKS.replace("SELECT o_orderkey, o_custkey", f"SELECT o_orderkey, {CAPTIONS} AS text, o_custkey").replace("SELECT s_suppkey AS page", "SELECT s_suppkey, s_suppkey AS page")


def _captioned(spark, d):
    """Blocks with captions, and tables, as in masked_blocks."""
    o, s = F.col("o_orderkey"), F.col("s_suppkey")
    box = lambda x, y, w, h: [c.cast("double").alias(n) for c, n in ((x, "x0"), (y, "y0"), (x + w, "x1"), (y + h, "y1"))]
    text = F.when(o % 5 == 0, F.concat(F.lit("Table "), (o % 9).cast("string"), F.lit("."), (o % 7).cast("string"), F.lit(" "), "o_orderpriority")).when(o % 5 == 1, F.concat(F.lit("Figure "), (o % 9).cast("string"), F.lit(".1 "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    blocks = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), *box(o * 7 % 80, o * 11 % 90, 10 + o % 9, F.lit(5)), text.alias("text"))
    tables = table(spark, d, "supplier").select(s.alias("page"), F.lit(1).alias("table_no"), *box(s * 13 % 60, s * 17 % 50, F.lit(40), F.lit(40)), F.lit(100.0).alias("height"))
    return blocks, tables


@query(f"""WITH {TITLES}, n AS (SELECT m.page, b.y0, b.x0, b.text, b.y0 < m.y0 AND b.y1 > greatest(0, m.y0 - 60) AS up, b.y0 < least(100, m.y1 + 80) AND b.y1 > m.y1 AS down FROM m JOIN b ON b.page = m.page AND b.x0 < m.x1 AND b.x1 > m.x0
), t AS (SELECT page, trim(coalesce(string_agg(text, chr(10) ORDER BY y0, x0, text) FILTER (up), '')) AS above, trim(coalesce(string_agg(text, chr(10) ORDER BY y0, x0, text) FILTER (down), '')) AS below FROM n GROUP BY 1
), c AS (SELECT page, above, below, trim(regexp_extract(above, 'Table\\s+\\d+\\.\\d+[^\\n]*')) AS a, trim(regexp_extract(below, '(?:Table|Figure)\\s+\\d+\\.\\d+[^\\n]*')) AS b FROM t)
SELECT m.page, coalesce(CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN above <> '' THEN substr(above, 1, 100) WHEN below <> '' THEN substr(below, 1, 100) END, '(başlık bulunamadı)') AS title,
  coalesce(CASE WHEN a <> '' THEN 'above' WHEN b <> '' THEN 'below' WHEN above <> '' THEN 'text above' WHEN below <> '' THEN 'text below' END, 'none') AS source FROM m LEFT JOIN c ON c.page = m.page""")
def table_titles(spark, d):
    blocks, tables = _captioned(spark, d)
    return titles.table_titles(tables, blocks).select("page", "title", "source")


@query(f"""WITH {TITLES} SELECT DISTINCT b.page FROM b WHERE regexp_matches(text, 'Table\\s+\\d+\\.\\d+\\s+[0-9A-Z]') AND b.page NOT IN (SELECT page FROM m WHERE page % 2 = 0)""")
def missing_tables(spark, d):
    """Pages that name a table, of those where none was found (every other supplier's table was)."""
    blocks, tables = _captioned(spark, d)
    named = blocks.withColumn("text", F.regexp_replace("text", r"(\.\d+\s+)\d", "$1P"))
    return titles.missing_tables(named.select("page", "text"), tables.where("page % 2 = 0")).distinct()
