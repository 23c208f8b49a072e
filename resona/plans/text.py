"""Queries on retrieval, ingestion, text rules and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from resona.functions import text as tx
from resona.operators import chunking, complexity
from resona.operators import evaluation as ev
from resona.operators import ingestion as ing
from resona.operators import retrieval as ret
from resona.plans.phrased import PHRASED, phrased
from resona.sources.held import spread
from resona.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TERMS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
DENSE = """d AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d)"""
PART = """d2 AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_inner_product(q.embedding[1:16]::DOUBLE[], v.embedding[1:16]::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0
), r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d2)"""
BM25 = f"""t AS (SELECT doc_id AS id, unnest({TERMS.format('text')}) AS term FROM documents
), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL
), l AS (SELECT id, count(*) AS len FROM t GROUP BY 1
), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) * 1.0::DOUBLE / (SELECT count(*) FROM documents) AS mean
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1
), q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark
), b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) JOIN l USING (id), st GROUP BY ALL
), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _dense(spark, d, k, dims=64):
    v = _vectors(spark, d).withColumn("embedding", F.slice("embedding", 1, dims))
    return ret.dense_top_k(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), k)


def _sparse(spark, d, k):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return ret.bm25_top_k(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


@query(f"WITH {DENSE} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 25")
def dense_topk(spark, d):
    return _dense(spark, d, 25).withColumn("score", F.round("score", 6))


@query(f"WITH {DENSE.replace('FROM embeddings q, embeddings v WHERE', 'FROM embeddings q, embeddings v WHERE v.label < 5 AND')} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def dense_topk_filtered(spark, d):
    v = _vectors(spark, d)
    out = ret.dense_top_k(v.where("label < 5"), v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)
    return out.withColumn("score", F.round("score", 6))


@query(f"WITH {BM25} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 25")
def sparse_bm25_topk(spark, d):
    return _sparse(spark, d, 25).select("query_id", "id", "score", "rank")


@query(f"""WITH {DENSE}, {PART}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM r WHERE rank <= 15 UNION ALL SELECT * FROM r2 WHERE rank <= 25) GROUP BY ALL
), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 10""")
def rrf_fusion(spark, d):
    return ret.fuse(_dense(spark, d, 25), _dense(spark, d, 25, 16), 10).select("query_id", "id", "score", "rank")


@query(f"""WITH {DENSE}, c AS (SELECT query_id, id, id % 40 AS parent, 1 / (1 + exp(-(14 * score - 7 + CASE WHEN query_id % 200 = 0 THEN 0 ELSE -6 END))) AS score FROM r WHERE rank <= 25 AND id <> query_id
), t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS best FROM c
), k AS (SELECT * FROM t WHERE CASE WHEN top >= 0.2 THEN score >= 0.2 WHEN top >= 0.1 THEN score >= 0.1 ELSE best = 1 END
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY score DESC, id) AS child FROM k
), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o WHERE child = 1)
SELECT query_id, id, parent, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 3""")
def rerank_cascade(spark, d):
    logit = 14 * F.col("score") - 7 + F.when(F.col("query_id") % 200 == 0, 0).otherwise(-6)
    c = _dense(spark, d, 25).where("id <> query_id").select("query_id", "id", (F.col("id") % 40).alias("parent"), logit.alias("logit"))
    return ret.rerank(c, 3).select("query_id", "id", "parent", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {BM25}, v AS (SELECT query_id, max(score) AS m FROM s WHERE rank = 1 GROUP BY 1)
SELECT item_id AS query_id, r_regionkey AS visual FROM benchmark, region WHERE item_id NOT IN (SELECT query_id FROM v WHERE m > 0 AND m >= 60)""")
def visual_fallback(spark, d):
    visuals = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(*map(F.lit, range(5)))).alias("visual"))
    return ret.visual_fallback(_sparse(spark, d, 1), visuals, 60.0)


@query("""WITH c AS (SELECT doc_id || '_child_' || k AS id, doc_id AS parent, substr(text, 1 + 500 * k, 500) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 500) AS BIGINT))) AS k FROM documents)
), p AS (SELECT doc_id, length(text) AS n, md5(text) AS h FROM documents WHERE lang = 'en')
SELECT c.id, c.parent, coalesce(n, length(c.text)) AS chars, coalesce(h, md5(c.text)) AS digest FROM c LEFT JOIN p ON doc_id = parent""")
def parent_merge(spark, d):
    docs = table(spark, d, "documents")
    k = F.explode(F.expr("sequence(0, cast((length(text) - 1) div 500 as int))")).alias("k")
    children = docs.where("length(text) > 0").select("doc_id", "text", k).select(F.concat(F.col("doc_id"), F.lit("_child_"), F.col("k")).alias("id"), F.col("doc_id").alias("parent"), F.substring("text", F.lit(1) + 500 * F.col("k"), F.lit(500)).alias("text"))
    # the parent's text stands for as many rows as it has children: its digest and length are taken before the join
    digest = lambda df: df.select(*(c for c in df.columns if c != "text"), F.concat_ws(":", F.length("text"), F.md5(F.col("text").cast("binary"))).alias("text"))
    merged = ret.merge_parents(digest(children), digest(docs.where("lang = 'en'").select(F.col("doc_id").alias("id"), "text")))
    return merged.select("id", "parent", F.split_part("text", F.lit(":"), F.lit(1)).cast("long").alias("chars"), F.split_part("text", F.lit(":"), F.lit(2)).alias("digest"))


@query(f"""WITH v AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source WHEN doc_id % 3 = 0 THEN 'unknown' END AS section, n_chars % 10 AS page, text FROM documents
), x AS (SELECT item_id AS id, 'src' || item_id % 7 AS section, item_id % 10 AS page, text FROM benchmark
), a AS (SELECT v.id FROM v WHERE v.section IS NOT NULL AND v.section <> 'unknown' AND NOT EXISTS (SELECT 1 FROM x WHERE x.section = v.section AND x.page = v.page)
), vw AS (SELECT id, list_distinct({TERMS.format('text')}) AS w FROM v WHERE coalesce(section, 'unknown') = 'unknown'
), xw AS (SELECT id, list_distinct({TERMS.format('text')}) AS w FROM x
), j AS (SELECT DISTINCT vw.id FROM vw, xw WHERE len(list_intersect(vw.w, xw.w)) > 0 AND len(list_intersect(vw.w, xw.w)) >= 0.4 * (len(vw.w) + len(xw.w) - len(list_intersect(vw.w, xw.w))))
SELECT id FROM a UNION ALL SELECT id FROM vw WHERE id NOT IN (SELECT id FROM j)""")
def visual_dedup(spark, d):
    v = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).when(F.col("doc_id") % 3 == 0, "unknown").alias("section"), (F.col("n_chars") % 10).alias("page"), "text")
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("src"), F.col("item_id") % 7).alias("section"), (F.col("item_id") % 10).alias("page"), "text")
    return ret.drop_seen_visuals(v, t).select("id")


@query(f"""WITH {BM25}, m AS (SELECT query_id // 8 AS question, query_id AS sub, id, rank, score FROM s WHERE rank <= 8
), k AS (SELECT *, row_number() OVER (PARTITION BY question, id ORDER BY sub, rank) AS k FROM m) SELECT question, sub, id, CAST(rank AS INTEGER) AS rank, score FROM k WHERE k = 1""")
def subquery_budget_merge(spark, d):
    r = _sparse(spark, d, 35).withColumnsRenamed({"query_id": "sub"}).withColumns({"query_id": F.floor(F.col("sub") / 8), "m": F.lit(8)})
    return ret.merge_sub_queries(r).select(F.col("query_id").alias("question"), "sub", "id", "rank", "score")


METRICS = DENSE + """, e AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0
), c AS (SELECT r.*, e.id IS NOT NULL AS hit FROM r LEFT JOIN e USING (query_id, id) WHERE rank <= 10
), f AS (SELECT query_id, count(*) AS n, count(*) FILTER (hit) AS hits, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg FROM c GROUP BY 1
), w AS (SELECT query_id, count(*) AS wanted FROM e GROUP BY 1
), m AS (SELECT query_id, hits * 1.0::DOUBLE / wanted AS recall, hits * 1.0::DOUBLE / n AS precision, CAST(hits > 0 AS DOUBLE) AS hit, coalesce(1.0::DOUBLE / first, 0) AS mrr, dcg / list_sum(list_transform(range(1, least(wanted, n) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM w JOIN f USING (query_id))"""


def _metrics(spark, d):
    """All vectors of a query's label are wanted: equal labels are hits, and a label's count is what is wanted; no list of pairs."""
    v = _vectors(spark, d).select("id", "label")
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    judged = _dense(spark, d, 10).join(v, "id").join(asked, "query_id").withColumn("hit", F.col("own") == F.col("label"))
    wanted = asked.join(v.groupBy(F.col("label").alias("own")).agg(F.count("*").alias("wanted")), "own").select("query_id", "wanted")
    return ret.judged_metrics(judged, wanted)


NAMES = ("recall", "precision", "hit", "mrr", "ndcg")


@query(f"WITH {METRICS} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in NAMES)} FROM m")
def retrieval_metrics(spark, d):
    return _metrics(spark, d).select("query_id", *(F.round(c, 6).alias(c) for c in NAMES))


@query(f"WITH {METRICS} SELECT coalesce(CAST(label AS VARCHAR), 'all') AS grp, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in NAMES)} FROM m JOIN embeddings ON vec_id = query_id GROUP BY GROUPING SETS ((label), ())")
def retrieval_metrics_by_group(spark, d):
    m = _metrics(spark, d).join(_vectors(spark, d).select(F.col("id").alias("query_id"), "label"), "query_id")
    g = m.groupingSets([["label"], []], "label").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in NAMES))
    return g.select(F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("grp"), "n", *NAMES)


LINES = "ln AS (SELECT doc_id, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)"


@query(f"""WITH {LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, md5(coalesce(last_value(CASE WHEN length(text) <= 40 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), 'unknown')) AS section FROM ln""")
def section_asof(spark, d):
    s = ing.section_of(ing.lines(table(spark, d, "documents")), F.length("text") <= 40)
    return s.select("doc_id", "line", F.md5(F.col("section").cast("binary")).alias("section"))


@query("""WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM i GROUP BY ALL""")
def section_islands(spark, d):
    return ing.islands(table(spark, d, "events"), "user_id", ["event_id"], "event_type").select("user_id", F.col("island").cast("long").alias("island"), "event_type", "n", "first", "last")


@query(f"""WITH RECURSIVE {LINES}, s AS (SELECT doc_id, line, CAST(greatest(1, length(text) // 4) AS BIGINT) AS size FROM ln
), f AS (SELECT doc_id, line, 0::BIGINT AS part, 1 AS n, size AS total FROM s WHERE line = 0
  UNION ALL SELECT s.doc_id, s.line, CASE WHEN f.total >= 150 THEN f.part + 1 ELSE f.part END, CASE WHEN f.total >= 150 THEN 1 ELSE f.n + 1 END, CASE WHEN f.total >= 150 THEN s.size ELSE f.total + s.size END FROM f JOIN s ON s.doc_id = f.doc_id AND s.line = f.line + 1)
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(max(n) AS INTEGER) AS n_groups, max(total) AS size FROM f GROUP BY doc_id, part""")
def merge_small_groups(spark, d):
    g = ing.lines(table(spark, d, "documents")).withColumn("size", ing.token_estimate(F.col("text")))
    return ing.merge_small(g, "doc_id", "line", "size")


@query()
def chunk_split(spark, d):
    """Parents, children and rejected documents."""
    return chunking.chunks(table(spark, d, "documents")).select("doc_id", "kind", "parent_id", "chunk_id", F.length("text").alias("chars"), "tokens")


CELLS = "c AS (SELECT page_id, list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x: string_split(regexp_replace(x, '<[^>]*>', '', 'g'), '/')) AS rows FROM pages)"


@query(f"""WITH {CELLS}, f AS (SELECT page_id, rows, flatten(rows) AS cells FROM c), n AS (SELECT page_id, rows, len(cells) AS cells, len(list_filter(cells, lambda x: trim(x) <> '')) AS filled FROM f)
SELECT page_id, cells, filled, cells < 4 OR filled < 3 OR filled * 1.0::DOUBLE / cells < 0.35 OR len(rows) < 2 AS ghost, list_bool_and(list_transform(rows, lambda r: len(r) = len(rows[1]))) AND filled >= 4 AND len(list_filter(rows[1], lambda x: trim(x) <> '')) >= 0.5 * len(rows[1]) AS reliable FROM n WHERE len(rows) > 0""")
def table_quality(spark, d):
    rows = F.transform(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1)), lambda x: F.split(F.regexp_replace(x, "<[^>]*>", ""), "/"))
    t = table(spark, d, "pages").select("page_id", rows.alias("rows")).where("size(rows) > 0")
    return t.select("page_id", ing.table_quality(F.col("rows")).alias("q")).select("page_id", F.col("q.cells").cast("long").alias("cells"), F.col("q.filled").cast("long").alias("filled"), "q.ghost", "q.reliable")


@query("""WITH t AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderpriority AS width, o_orderkey % 5 = 0 AS titled FROM orders
), m AS (SELECT *, coalesce(lag(page) OVER w = page - 1 AND lag(width) OVER w = width AND NOT titled, false) AS go FROM t WINDOW w AS (PARTITION BY doc ORDER BY page)
), r AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page) AS run FROM m)
SELECT doc, CAST(page AS INTEGER) AS page, (row_number() OVER (PARTITION BY doc, run ORDER BY page) - 1) % 2 = 1 AS merged FROM r""")
def cross_page_merge(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), F.col("o_orderpriority").alias("width"), (F.col("o_orderkey") % 5 == 0).alias("titled"))
    return ing.merge_pages(t, "doc", "page", "width", "titled").select("doc", "page", "merged")


def _caption_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + ")"


CAPTION = f"x AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, {PHRASED} AS t FROM (SELECT page_id, html, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages))"


def _captions(spark, d):
    p = table(spark, d, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return p.select("page_id", "bytes", phrased(F.col("text")).alias("t"))


@query(f"""WITH {CAPTION} SELECT page_id, CASE {' '.join(f"WHEN {_caption_sql(w)} THEN '{k}'" for k, w in ing.ROUTES.items())} ELSE 'unified' END AS route, t <> '' AND ({_caption_sql(ing.SKIPPED_CAPTIONS)} OR bytes < 5000) AS skipped FROM x""")
def caption_route(spark, d):
    return _captions(spark, d).select("page_id", ing.route(F.col("t")).alias("route"), ing.skip(F.col("t"), F.col("bytes")).alias("skipped"))


@query("""WITH x AS (SELECT p_partkey, ['misalignment', 'unbalance', 'rub', ''][1 + p_partkey % 4] AS fault, ['circular', 'banana_shape', 'Figure Eight', 'other', ''][1 + p_partkey % 5] AS orbit, ['Unbalance of a rotor', 'a misalignment case', 'plot', ''][1 + p_partkey % 3] AS caption, ['1st CYCLE of', 'plain peaks'][1 + p_partkey % 2] AS t, ['spectrum', 'diagram', 'logo'][1 + p_partkey % 3] AS kind FROM part)
SELECT p_partkey, (fault <> '' AND caption <> '' AND length(fault) > 3 AND NOT contains(lower(caption), fault)) OR coalesce(CASE lower(replace(orbit, ' ', '_')) WHEN 'circular' THEN fault NOT IN ('none', 'normal', 'healthy', 'unbalance') WHEN 'banana_shape' THEN fault <> 'misalignment' WHEN 'figure_eight' THEN fault <> 'misalignment' END, false) OR (kind = 'spectrum' AND t = '1st CYCLE of') AS review, kind <> 'logo' AS ingested FROM x""")
def review_flags(spark, d):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    x = table(spark, d, "part").select("p_partkey", pick(["misalignment", "unbalance", "rub", ""]).alias("fault"), pick(["circular", "banana_shape", "Figure Eight", "other", ""]).alias("orbit"), pick(["Unbalance of a rotor", "a misalignment case", "plot"]).alias("caption"), pick(["1st CYCLE of", "plain peaks"]).alias("t"), pick(["spectrum", "diagram", "logo"]).alias("kind"))
    return x.select("p_partkey", ing.needs_review(*(F.col(c) for c in ("fault", "caption", "orbit", "t", "kind"))).alias("review"), ing.worth_ingesting(F.col("kind"), F.lit("")).alias("ingested"))


@query("""WITH v AS (SELECT doc_id, lang, n_chars, 1 AS version FROM documents UNION ALL SELECT doc_id, upper(lang), n_chars + 1, 2 FROM documents WHERE source = 'src1')
SELECT DISTINCT ON (doc_id) doc_id, lang, n_chars, version FROM v ORDER BY doc_id, version DESC""")
def doc_upsert_latest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.lit(1).alias("version"))
    changed = table(spark, d, "documents").where("source = 'src1'").select("doc_id", F.upper("lang").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"), F.lit(2).alias("version"))
    return ing.latest(docs.unionByName(changed), "doc_id", "version")


@query(f"WITH {BM25} SELECT query_id // 8 AS question, query_id AS sub, id, 'K' || row_number() OVER (PARTITION BY query_id // 8 ORDER BY query_id, rank) AS citation FROM s WHERE rank <= 4")
def citation_numbering(spark, d):
    from pyspark.sql import Window

    r = _sparse(spark, d, 4).withColumn("question", F.floor(F.col("query_id") / 8))
    n = F.row_number().over(Window.partitionBy("question").orderBy("query_id", "rank"))
    return r.select("question", F.col("query_id").alias("sub"), "id", F.concat(F.lit("K"), n).alias("citation"))


@query("""SELECT doc_id, md5(lower(translate(text, 'İIÖÜŞÇĞ', 'iıöüşçğ'))) AS folded, md5(translate(lower(translate(text, 'İI', 'iı')), 'çğıöşü', 'cgiosu')) AS ascii FROM documents""")
def tr_normalize(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(tx.fold_turkish(t).cast("binary")).alias("folded"), F.md5(tx.ascii_turkish(t).cast("binary")).alias("ascii"))





LETTER = r"[\p{L}\p{N}_]"
NOT_LETTER = r"[^\p{L}\p{N}_]"
TERMS_TABLE = "terms(family, name, parts) AS (VALUES " + ", ".join(f"('{f}', '{n}', {n.split()})" for f, names in tx.FAULT_KEYWORDS.items() for n in names) + ")"
#: SQL: the clauses of a folded text, and whether a clause's words ws hold those of a term (parts) and refuse it.
CLAUSES = rf"""string_split_regex(regexp_replace(regexp_replace(translate(@x, '.!?;,', repeat(chr(10), 5)), '(^|{NOT_LETTER})({'|'.join(tx.CONTRASTS)})({NOT_LETTER}|$)', '\1' || chr(10) || '\3', 'g'),
  '(^|{NOT_LETTER})({'|'.join(tx.CONTRASTS)})({NOT_LETTER}|$)', '\1' || chr(10) || '\3', 'g'), '\n+')"""
REFUSED = rf"""len(list_filter(range(1, len(ws) - len(parts) + 2), lambda i: ws[i:i + len(parts) - 1] = parts
  AND (regexp_matches(' ' || array_to_string(ws[greatest(1, i - 6):i + len(parts) + 5], ' ') || ' ', '{tx.NEAR}') OR regexp_matches(array_to_string(ws[greatest(1, len(ws) - 2):], ' '), '{tx.LAST}')))) > 0"""
#: SQL: from x (id, text) to told (id, family, name, refused): a row for each term that a sentence names.
TOLD = rf"""cut AS (SELECT id, string_split_regex(@f, '[.!?;\n]+') AS many FROM x), sent AS (SELECT id, unnest(many) AS sentence, generate_subscripts(many, 1) AS n FROM cut
), named AS (SELECT id, n, sentence, family, name, parts FROM sent JOIN terms ON contains(sentence, name)
), part AS (SELECT id, n, unnest(@c) AS clause FROM (SELECT DISTINCT id, n, sentence FROM named)
), worded AS (SELECT id, n, clause, regexp_extract_all(clause, '{tx.WORD}') AS ws FROM part
), told AS (SELECT id, n, family, name, bool_or(contains(clause, name) AND {REFUSED}) AS refused FROM named JOIN worded USING (id, n) GROUP BY ALL)"""
FOLDED = "lower(translate(@x, 'İIÖÜŞÇĞ', 'iıöüşçğ'))"


def _sql(template: str, x: str) -> str:
    return template.replace("@x", x)


TOLD = TOLD.replace("@f", _sql(FOLDED, "text")).replace("@c", _sql(CLAUSES, "sentence"))


def _phrased(spark, d, name, *keys):
    return spread(table(spark, d, name).select(*keys, "text")).select(*keys, phrased(F.col("text")).alias("text"))


FLAGS = {
    "paired_question": rf"(?i){LETTER}\s+m[iı]\s+{LETTER}+\s+m[iı]", "versus": rf"(^|{NOT_LETTER})vs({NOT_LETTER}|$)",
    "comparison": rf"(^|{NOT_LETTER})((fark|ayrim|ayirt|kiyasla)({NOT_LETTER}|$)|karsilastir)", "alternative": rf"(^|{NOT_LETTER})(yoksa|ya da|veya)({NOT_LETTER}|$)",
    "question_suffix": rf"(^|{NOT_LETTER})(nedir|nasil|nelerdir|nasildir)({NOT_LETTER}|$)",
}


@query(rf"""WITH x AS (SELECT conv_id, turn, {PHRASED} AS q FROM conversations), w AS (SELECT *, list_filter(regexp_split_to_array(q, '[ \t\n\x0B\f\r]+'), lambda t: t <> '') AS words FROM x)
SELECT conv_id, turn, len(words)::DOUBLE AS n_tokens, length(q)::DOUBLE AS n_chars, {', '.join(f"CAST(regexp_matches(q, '{p}') AS DOUBLE) AS {n}" for n, p in FLAGS.items())},
  len(list_intersect(list_distinct(words), ['the', 'and', 'fark']))::DOUBLE AS domain_terms, CASE WHEN len(words) > 0 THEN round(len(list_distinct(words)) * 1.0::DOUBLE / len(words), 6) ELSE 0 END AS type_token_ratio FROM w""")
def lexical_features(spark, d):
    q = _phrased(spark, d, "conversations", "conv_id", "turn")
    f = q.select("conv_id", "turn", tx.lexical_features(F.col("text"), F.array(*map(F.lit, ("the", "and", "fark")))).alias("f")).select("conv_id", "turn", "f.*")
    return f.withColumn("type_token_ratio", F.round("type_token_ratio", 6))


@query(rf"""WITH x AS (SELECT conv_id, turn, {PHRASED} AS text FROM conversations), y AS (SELECT conv_id, turn, regexp_matches(text, '(?i)(^|{NOT_LETTER})((iso|vdi|ird|din)\s*\d|(bpfo|bpfi|bsf|ftf|vpf|rms|fft|hfd|n|\d+(\.\d+)?x)({NOT_LETTER}|$))') AS technical FROM x)
SELECT conv_id, turn, CASE WHEN technical THEN 0.2 ELSE 0.4 END::DOUBLE AS dense, CASE WHEN technical THEN 0.8 ELSE 0.6 END::DOUBLE AS sparse FROM y""")
def query_weight_route(spark, d):
    w = _phrased(spark, d, "conversations", "conv_id", "turn").select("conv_id", "turn", tx.query_weights(F.col("text")).alias("w"))
    return w.select("conv_id", "turn", F.col("w.dense").cast("double").alias("dense"), F.col("w.sparse").cast("double").alias("sparse"))


FAULTS = ["inner race fault", "BPFO", "Dengesizlik (Unbalance)", "Açısal kaçıklık", "misalignment", "looseness"]
ZONES = ["Zone A", "B", "zone c", "Zone D"]


@query(rf"""WITH y AS (SELECT conv_id, turn, {PHRASED} AS text, {FAULTS}[CAST('0x' || substr(md5(conversations.text), 1, 7) AS BIGINT) % 6 + 1] AS fault, {ZONES}[CAST('0x' || substr(md5(conversations.text), 8, 7) AS BIGINT) % 5 + 1] AS zone FROM conversations
), x AS (SELECT conv_id || '/' || turn AS id, * FROM y), {TERMS_TABLE}, {TOLD}
, rivals(fault, own, other) AS (VALUES ('inner race fault', 'inner_race_fault', 'outer_race_fault'), ('BPFO', 'outer_race_fault', 'inner_race_fault'), ('Dengesizlik (Unbalance)', 'unbalance', 'misalignment'), ('Açısal kaçıklık', 'misalignment', 'unbalance'), ('misalignment', 'misalignment', 'unbalance')
), m AS (SELECT id, bool_or(family = CASE WHEN refused THEN own ELSE other END) AS bad FROM x JOIN rivals USING (fault) JOIN told USING (id) GROUP BY 1
), z AS (SELECT id, zone, letter, 'zone ' || letter AS name, ['zone', letter] AS parts, unnest({_sql(CLAUSES, _sql(FOLDED, 'text'))}) AS clause FROM x, (SELECT unnest(['a', 'b', 'c', 'd']) AS letter) WHERE regexp_matches(lower(text), '(^|{NOT_LETTER})zone\s*' || letter || '({NOT_LETTER}|$)')
), v AS (SELECT *, regexp_extract_all(clause, '{tx.WORD}') AS ws FROM z
), k AS (SELECT id, zone, letter, bool_or(contains(clause, name) AND {REFUSED}) AS refused FROM v GROUP BY ALL), w AS (SELECT id, bool_or(upper(right(zone, 1)) <> upper(letter) AND NOT refused) AS wrong FROM k GROUP BY 1)
SELECT conv_id, turn, coalesce(bad, false) AS fault_mismatch, coalesce(wrong, false) AS zone_mismatch FROM x LEFT JOIN m USING (id) LEFT JOIN w USING (id)""")
def consistency_check(spark, d):
    pick = lambda at, values, n: F.try_element_at(F.array(*map(F.lit, values)), (F.conv(F.substring(F.md5(F.col("text").cast("binary")), at, 7), 16, 10).cast("long") % n + 1).cast("int"))
    c = table(spark, d, "conversations").select("conv_id", "turn", phrased(F.col("text")).alias("text"), pick(1, FAULTS, 6).alias("fault"), pick(8, ZONES, 5).alias("zone"))
    c = c.select("conv_id", "turn", ev.consistency(F.col("text"), F.col("fault"), F.col("zone")).alias("c"))
    return c.select("conv_id", "turn", "c.fault_mismatch", "c.zone_mismatch")


@query(rf"""WITH x AS (SELECT doc_id AS id, {PHRASED} AS text FROM documents), {TERMS_TABLE}, {TOLD}
, g AS (SELECT id, bool_or(refused) FILTER (family = 'outer_race_fault') AS a, bool_or(NOT refused) FILTER (family = 'outer_race_fault') AS b, bool_or(refused) FILTER (family = 'inner_race_fault') AS c, bool_or(refused) FILTER (name = 'unbalance') AS u FROM told GROUP BY 1)
SELECT x.id AS doc_id, coalesce(a, false) AS outer_denied, coalesce(b, false) AS outer_affirmed, coalesce(c, false) AS inner_denied, coalesce(u, false) AS unbalance_negated FROM x LEFT JOIN g USING (id)""")
def negation_flags(spark, d):
    a, t = _phrased(spark, d, "documents", "doc_id"), F.col("text")
    outer, inner = (tx.terms(tx.FAULT_KEYWORDS[f"{x}_race_fault"]) for x in ("outer", "inner"))
    return a.select("doc_id", tx.denied(t, outer).alias("outer_denied"), tx.affirmed(t, outer).alias("outer_affirmed"), tx.denied(t, inner).alias("inner_denied"), tx.negated(t, "unbalance").alias("unbalance_negated"))


def _expanded_sql() -> str:
    """SQL: the list of added terms after each cluster, one table a cluster."""
    out = "e0 AS (SELECT *, []::VARCHAR[] AS t FROM l)"
    for n, (triggers, more) in enumerate(tx.SYNONYMS, 1):
        fired = f"len(list_filter({triggers}, lambda x: contains(low, {_sql(FOLDED, 'x')}))) > 0"
        fresh = f"list_filter({more}, lambda e: NOT contains(low, {_sql(FOLDED, 'e')}) AND NOT list_contains(t, e))"
        out += f", e{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {fired} THEN t || ({fresh})[1:greatest(1, 3 - len(t))] ELSE t END AS t) FROM e{n - 1})"
    return out


@query(rf"""WITH x AS (SELECT conv_id, turn, {PHRASED} AS text FROM conversations), l AS (SELECT *, {_sql(FOLDED, 'text')} AS low FROM x), {_expanded_sql()}
SELECT conv_id, turn, md5(CASE WHEN len(t) > 0 THEN text || ' (' || array_to_string(t[1:3], ', ') || ')' ELSE text END) AS expanded, CAST(len(t) AS INTEGER) AS added FROM e{len(tx.SYNONYMS)}""")
def dict_expand(spark, d):
    out = _phrased(spark, d, "conversations", "conv_id", "turn").withColumn("expanded", tx.expand(F.col("text")))
    return out.select("conv_id", "turn", F.md5(F.col("expanded").cast("binary")).alias("expanded"), tx.expansions(F.col("text")).alias("n")).select("conv_id", "turn", "expanded", F.size("n").alias("added"))


@query(rf"""WITH {BM25}, c AS (SELECT s.query_id, rank, text, max(score) OVER (PARTITION BY query_id) AS top FROM s JOIN documents ON doc_id = id WHERE rank <= 3
), p AS (SELECT query_id, rank, regexp_extract_all(text, '[A-Za-z0-9İıŞşĞğÜüÇçÖö_-]{{3,}}') AS ws FROM c WHERE top >= 40
), w AS (SELECT query_id, rank, unnest(ws) AS term, unnest(range(0, len(ws))) AS pos FROM p
), k AS (SELECT query_id, term, count(*) AS n, min(rank * 1000000 + pos) AS first FROM w WHERE NOT regexp_matches(term, '^[0-9]+$') AND lower(term) NOT IN ({', '.join(f"'{s}'" for s in tx.STOP_WORDS)}) GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS place FROM k) SELECT query_id, term, n, CAST(place AS INTEGER) AS place FROM o WHERE place <= 3""")
def prf_terms(spark, d):
    # three hits a query are the small side
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(_sparse(spark, d, 3)), "id")
    return ev.feedback_terms(hits, guard=40.0).select("query_id", "term", "n", "place")


@query(rf"""WITH t AS (SELECT doc_id, toxic, unnest({TERMS.format('text')}) AS term FROM documents JOIN labels USING (doc_id)
), c AS (SELECT term, count(DISTINCT doc_id) AS texts, count(*) AS n, sum(toxic) AS n1 FROM t WHERE length(term) >= 3 AND term NOT IN ({', '.join(f"'{s}'" for s in tx.STOP_WORDS)}) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3
), p AS (SELECT avg(toxic::DOUBLE) AS p FROM labels JOIN documents USING (doc_id)
), x AS (SELECT term, n, pow(n1 - n * p, 2) / (n * p) + pow(n - n1 - n * (1 - p), 2) / (n * (1 - p)) AS chi2 FROM c, p) SELECT term, n, round(chi2, 4) AS chi2 FROM x WHERE chi2 > 3.841458820694124""")
def domain_terms_chi2(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    j = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), ret.tokens(F.col("text")).alias("terms"))
    return ev.domain_terms(j).select("term", "n", F.round("chi2", 4).alias("chi2"))


STATE = "x AS (SELECT conv_id, turn, turn % 3 AS retrieval, conv_id % 3 AS generation, turn % 3 + conv_id % 2 AS total, CASE WHEN conv_id % 11 = 0 THEN '' ELSE text END AS response, conv_id % 5 <> 0 AS consistent, (conv_id % 10) / 10.0::DOUBLE AS faithfulness, 0.4::DOUBLE + (turn % 6) / 10.0::DOUBLE AS relevance FROM conversations)"


def _state(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", (t % 3).alias("retrieval"), (c % 3).alias("generation"), (t % 3 + c % 2).alias("total"), F.when(c % 11 == 0, "").otherwise(F.col("text")).alias("response"), (c % 5 != 0).alias("consistent"), (c % 10 / 10.0).alias("faithfulness"), (0.4 + t % 6 / 10.0).alias("relevance"))


DECIDED = STATE + """, y AS (SELECT *, CASE WHEN total >= 3 OR (retrieval >= 2 AND generation >= 2) THEN 'approved_with_warning' WHEN trim(coalesce(response, '')) = '' OR NOT consistent THEN 'retry_generation' WHEN faithfulness < 0.7 OR relevance < 0.65 THEN 'retry_retrieval' ELSE 'approved' END AS decision FROM x)"""


@query(f"WITH {DECIDED} SELECT conv_id, turn, decision, CASE WHEN decision = 'retry_retrieval' THEN CASE retrieval WHEN 0 THEN 'domain_dictionary' WHEN 1 THEN 'pseudo_relevance_feedback' ELSE 'llm_query_rewriter' END END AS strategy, CAST(total + CASE WHEN decision LIKE 'retry%' THEN 1 ELSE 0 END AS BIGINT) AS total FROM y")
def corrector_decision(spark, d):
    return ev.decide(_state(spark, d)).select("conv_id", "turn", "decision", "strategy", F.col("total").cast("long").alias("total"))


@query()
def corrector_simulation(spark, d):
    return ev.simulate(_state(spark, d)).groupBy("decision", "steps").agg(F.count("*").alias("n"))


CONF = "c AS (SELECT source, toxic = 1 AS truth, n_chars > 2000 AS flag FROM labels JOIN documents USING (doc_id)), n AS (SELECT source, count(*) FILTER (truth AND flag) AS tp, count(*) FILTER (NOT truth AND flag) AS fp, count(*) FILTER (truth AND NOT flag) AS fn, count(*) FILTER (NOT truth AND NOT flag) AS tn FROM c GROUP BY 1)"


@query(f"""WITH {CONF}, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1.0::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp * 1.0::DOUBLE / (tp + fn) ELSE 0 END AS r FROM n)
SELECT source, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""")
def checker_confusion(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    c = ev.confusion(j, ["source"], F.col("toxic") == 1, F.col("n_chars") > 2000)
    return c.select("source", "tp", "fp", "fn", "tn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query("""WITH s AS (SELECT toxic = 1 AS truth, (doc_id * 37 % 101) / 100.0::DOUBLE AS a, (n_chars * 13 % 97) / 96.0::DOUBLE AS b FROM labels JOIN documents USING (doc_id)
), g AS (SELECT *, x AS first, y AS second FROM s, (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75])::DOUBLE AS x), (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7])::DOUBLE AS y)
), n AS (SELECT first, second, count(*) FILTER (truth AND (a < first OR b < second)) AS tp, count(*) FILTER (NOT truth AND (a < first OR b < second)) AS fp, count(*) FILTER (truth AND NOT (a < first OR b < second)) AS fn, count(*) FILTER (NOT truth AND NOT (a < first OR b < second)) AS tn FROM g GROUP BY ALL
), u AS (SELECT *, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END - 1.5::DOUBLE * fp / (fp + tn) AS u FROM n) SELECT first, second, tp, fp, round(u, 6) AS utility FROM u ORDER BY round(u, 9) DESC, first, second LIMIT 5""")
def threshold_grid(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    g = ev.threshold_grid(j, [0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75], [0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7], F.col("toxic") == 1, F.col("doc_id") * 37 % 101 / 100.0, F.col("n_chars") * 13 % 97 / 96.0)
    return g.select("first", "second", "tp", "fp", F.round("utility", 6).alias("utility"))


@query("""SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, substr(min_by(text, turn) FILTER (role = 'user'), 1, 50) AS preview FROM conversations GROUP BY 1 ORDER BY 1 DESC LIMIT 50""")
def sessions_recent(spark, d):
    return ev.sessions(table(spark, d, "conversations"))


@query(r"""WITH w AS (SELECT conv_id, role, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n FROM conversations), t AS (SELECT conv_id, sum(n) FILTER (role <> 'assistant') AS a, coalesce(sum(n) FILTER (role = 'assistant'), 0) AS b FROM w GROUP BY 1)
SELECT conv_id, CAST(coalesce(a, 0) * 4 // 3 AS BIGINT) AS tokens_in, CAST(b * 4 // 3 AS BIGINT) AS tokens_out, round(((coalesce(a, 0) * 4 // 3) * 0.075::DOUBLE + (b * 4 // 3) * 0.3::DOUBLE) / 1e6, 6) AS cost FROM t""")
def token_cost(spark, d):
    n = F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("role") != "assistant", n)), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).alias("b"))
    return t.select("conv_id", tx.cost(F.col("a"), F.col("b"), 0.075, 0.3).alias("c")).select("conv_id", "c.*")


@query(r"""WITH x AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 20) || '<think>' || text || '</think>' || substr(text, 21) || '</think>' WHEN 2 THEN text || '<think>' || text || '</think>  ' ELSE CASE WHEN conv_id % 3 = 0 THEN '' ELSE ' ' || left(text, 9) END || '<think>' || text END AS raw FROM conversations WHERE text IS NOT NULL
), y AS (SELECT *, string_split(raw, '</think>') AS a, regexp_extract_all(raw, '"([^"\n]{10,200})"', 1) AS quotes,
  list_filter(list_transform(string_split(replace(raw, '<think>', ''), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '' AND NOT regexp_matches(l, '^([*#-]|[1-5]\.)')) AS lines FROM x
), z AS (SELECT *, regexp_replace(CASE WHEN contains(raw, '<think>') AND len(a) > 1 THEN array_to_string(a[2:], '</think>') WHEN NOT contains(raw, '<think>') THEN raw
  WHEN trim(string_split(raw, '<think>')[1], ' ') <> '' THEN string_split(raw, '<think>')[1] ELSE coalesce(quotes[-1], lines[-1], '') END, '^\s+|\s+$', '', 'g') AS kept FROM y)
SELECT conv_id, turn, md5(CASE WHEN kept <> '' THEN kept ELSE regexp_replace(raw, '^\s+|\s+$', '', 'g') END) AS answer FROM z""")
def think_strip(spark, d):
    """Turns as answers: as they are, with a block inside or at the end, and with one that is never closed."""
    t, k = F.col("text"), F.col("turn") % 4
    block = F.concat(F.lit("<think>"), t, F.lit("</think>"))
    before = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.substring(t, 1, 9)))
    raw = F.when(k == 0, t).when(k == 1, F.concat(F.substring(t, 1, 20), block, F.expr("substring(text, 21)"), F.lit("</think>"))).when(k == 2, F.concat(t, block, F.lit("  "))).otherwise(F.concat(before, F.lit("<think>"), t))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.md5(tx.without_thoughts(raw).cast("binary")).alias("answer"))


@query()
def complexity_classifier(spark, d):
    """Cross-validation over the turns of conversations: whose they are, told from their whole texts."""
    return complexity.cross_validate(_turns(spark, d), ["the", "and"], steps=20).select("metric", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


def _turns(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), (F.col("role") != "user").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"""WITH t AS (SELECT conv_id || ':' || turn AS id, CAST(role <> 'user' AS INTEGER) AS label FROM conversations), r AS (SELECT label, count(*) AS n FROM t GROUP BY 1
), k AS (SELECT label, n, unnest(range(0, 5)) AS fold FROM r) SELECT label, CAST(fold AS INTEGER) AS fold, CAST((n + 5 - CASE fold WHEN 0 THEN 5 ELSE fold END) // 5 AS BIGINT) AS n FROM k WHERE (n + 5 - CASE fold WHEN 0 THEN 5 ELSE fold END) // 5 > 0""")
def complexity_folds(spark, d):
    """Rows of each class in each fold: classes are dealt out evenly."""
    return complexity.folds(_turns(spark, d), 5).groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL""")
def tumbling_rms(spark, d):
    from resona.streaming.windows import tumbling

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(e, "1 hour").withColumns({"start": F.col("start").cast("timestamp_ntz"), "rms": F.round("rms", 6)})


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""")
def session_windows(spark, d):
    from resona.streaming.windows import sessions

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "30 minutes").withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})
