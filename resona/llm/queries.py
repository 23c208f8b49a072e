"""Queries of the operators and the pipeline, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.topk_search import top_k

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return top_k(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 10)


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL
), len AS (
  SELECT doc_id, count(*) AS len FROM t GROUP BY 1
), stats AS (
  SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM t) * 1.0::DOUBLE / (SELECT count(*) FROM documents) AS mean
), idf AS (
  SELECT term, ln(1 + (docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, stats GROUP BY term, docs
), s AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.n * idf * d.n * 2.2::DOUBLE / (d.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM tf q JOIN tf d ON d.term = q.term JOIN idf ON idf.term = q.term JOIN len ON len.doc_id = d.doc_id, stats
  WHERE q.doc_id % 100 = 0 GROUP BY ALL
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.mixing import mix, placed

    # whole rows are shuffled and written; the places are those of the texts read back
    mixed = scratch.keep(mix(_table(spark, sf_dir, "documents"), 17), "mixed")
    return mixed.select("doc_id", "source", "replica", F.round(placed(17, "doc_id"), 9).alias("place"))


OP6_SQL = """
WITH s AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY 1
), w AS (
  SELECT source, CASE WHEN chars > 0 THEN pow(chars, 0.7) / (SELECT sum(pow(chars, 0.7)) FROM s) * (SELECT sum(chars) FROM s) / chars ELSE 1.0 END AS rate FROM s
), v AS (
  SELECT source, CAST(greatest(1, ceil(rate / 64)) AS BIGINT) AS draws, rate / greatest(1, ceil(rate / 64)) AS mean FROM w
), k AS (
  SELECT source, mean, unnest(range(0, CAST(ceil(mean + 12 * sqrt(mean) + 16) AS BIGINT) + 1)) AS k FROM v
), p AS (
  SELECT source, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM k
), c AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p
), e AS (
  SELECT doc_id, d.source, md5(coalesce(text, '')) AS m, unnest(range(1, draws + 1)) AS i FROM documents d JOIN v ON d.source IS NOT DISTINCT FROM v.source
), u AS (
  SELECT doc_id, source, m, i, (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || m || CASE WHEN i > 1 THEN ':' || i ELSE '' END), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0 AS u FROM e
), n AS (
  SELECT u.doc_id, u.source, u.m, count(c.k) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u GROUP BY ALL
), r AS (
  SELECT doc_id, source, m, CAST(unnest(range(0, n)) AS INTEGER) AS replica FROM n
)
SELECT doc_id, source, replica,
       round((CAST('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || replica || ':' || m), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0, 9) AS place
FROM r
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from resona.llm.token_counts import token_counts

    old, new = (("byte_bpe_50k", "byte_bpe_50k.json"), ("word_bpe_49k", "word_bpe_49k.json"))
    return token_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), *((name, public_tokenizers.path(file)) for name, file in (old, new)))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS win
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 18)) AS p) x
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM s
), gone AS (
  SELECT DISTINCT doc_id, p + o AS q FROM r, (SELECT unnest(range(0, 20)) AS o) x WHERE k > 1
), words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS q FROM w
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.q) AS text, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.q = words.q WHERE gone.q IS NULL GROUP BY 1
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[p:p + 4], ' ')) AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 2))) AS p) x WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS whole FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)
), r AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
), c AS (
  SELECT doc_id, min(other) AS class_id FROM r GROUP BY 1
), k AS (
  SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1
)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
       CASE WHEN whole IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY whole) END AS n_copies
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


def grade() -> Column:
    """Ratings of `labels` as grades: 0 toxic, 1 of low quality, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm import quality

    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), grade(), 3)
    out = quality.score(docs.select("doc_id", "text"), model, 2)
    return out.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("keep"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from resona.llm.token_store import token_store

    out = token_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(_table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_words", "n_repeated", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS win
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS p) x
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k, count(*) OVER (PARTITION BY win) AS n FROM s
), gone AS (
  SELECT doc_id, p + o AS q, max(k) > 1 AS later FROM r, (SELECT unnest(range(0, 50)) AS o) x WHERE n > 1 GROUP BY 1, 2
), words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS q FROM w
), kept AS (
  SELECT words.doc_id, count(gone.q) AS n_repeated, count(*) FILTER (coalesce(later, false)) AS n_removed,
         string_agg(word, ' ' ORDER BY words.q) FILTER (NOT coalesce(later, false)) AS text
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.q = words.q GROUP BY 1
)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, n_repeated, n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w JOIN kept ON kept.doc_id = w.doc_id WHERE n_repeated > 0
"""

def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.lm_scoring import lm_scores

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return lm_scores(_table(spark, sf_dir, "documents"), F.crc32(name.cast("binary")) % 7 == 2)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def _op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds spelt out: parts p (part, id, x), codebooks b0 to b4, assignments a0 to a4."""
    near = """k{r} AS (
  SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min(CAST(list_inner_product(p.xd, p.xd) + list_inner_product(b.e, b.e) - 2 * list_inner_product(b.e, p.xd) AS BIGINT) * 256 + b.entry) AS k
  FROM p JOIN b{r} b ON b.part = p.part GROUP BY p.vec_id, p.label, p.part
), a{r} AS (
  SELECT vec_id, label, part, x, k % 256 AS entry, k // 256 AS far FROM k{r}
)"""
    mean = """m{r} AS (
  SELECT part, entry, pos, CAST(floor(sum(x[pos]) / count(*)) AS DOUBLE) AS c FROM a{r}, (SELECT unnest(range(1, w + 1)) AS pos FROM dim) GROUP BY ALL
), b{n} AS (
  SELECT b.part, b.entry, coalesce(k.e, b.e) AS e FROM b{r} b LEFT JOIN (SELECT part, entry, list(c ORDER BY pos) AS e FROM m{r} GROUP BY ALL) k ON k.part = b.part AND k.entry = b.entry
)"""
    steps = [step.format(r=r, n=r + 1) for r in range(rounds) for step in (near, mean)] + [near.format(r=rounds)]
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * c::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), dim AS (
  SELECT max(len(x)) // {parts} AS w FROM v
), p AS (
  SELECT vec_id, label, part, x[part * w + 1:part * w + w] AS x, list_transform(x[part * w + 1:part * w + w], lambda c: c::DOUBLE) AS xd FROM v, dim, (SELECT unnest(range(0, {parts})) AS part)
), b0 AS (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, xd AS e FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
), {", ".join(steps)}, c AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from resona.llm.whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_store": op3_token_store,
    "op4_topk_search": op4_topk_search,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_vector_codes": op12_vector_codes,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op1_ngram_join": OP1_SQL,
    "op4_topk_search": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op12_vector_codes": _op12_sql(),
}
