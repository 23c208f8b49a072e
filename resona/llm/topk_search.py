"""Exact top-k BM25 search over an inverted index with block maxima.

Document frequencies and lengths are counted over all documents first. Each task then indexes its documents
in shards of bounded size (`resona.operators.postings`) and runs all queries against each, some hundred at a
time: a query's terms give every block of documents an upper bound (the sum of the terms' largest impacts in
that block); the block of the highest bound is scored first, and blocks whose bound falls below the k-th score
so far, of this or an earlier shard of the task, are skipped. Bounds skip little when queries are whole texts,
so scoring is what has to be cheap: terms that a good part of a block has are rows over its documents, a matrix
product for all queries at once, and the lists of others are added up. Every shard returns its best k, scored
with the global statistics, so the best k of those are the exact answer.

Queries reach the tasks as a table in the shared folder, read in small batches, so neither their number nor
the corpus is bounded by memory (a task keeps one number for each query).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import scratch
from resona.operators.postings import BLOCK, SHARD_DOCS, frequencies, searched, term_counts

K1, B = 1.2, 0.75


def _search(batches: Iterator[pa.RecordBatch], files: list[str], mean: float, k: int, block: int, shard_docs: int) -> Iterator[pa.RecordBatch]:
    parts = ((batch.column(0).to_numpy(zero_copy_only=False), *term_counts(batch.column(1)), batch.nbytes) for batch in batches)
    for found in searched(parts, files, mean, k, K1, B, block, shard_docs):
        yield found.rename_columns(["query_id", "doc_id", "score"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, terms, counts, _ = term_counts(batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy(zero_copy_only=False)[docs]), pa.array(terms.view(np.int64)), pa.array(counts)], ["query_id", "term", "n"])


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """query_id, rank, doc_id, score: the k documents of the highest BM25 score for each query.

    queries: columns query_key and text; a term that a query repeats counts as often. Ranks go by score to
    six decimals, then by id. Documents without a term of the query aren't returned, so a query has under k
    rows if fewer match; null and empty texts match nothing, and empty documents count in the statistics.
    Rows of null key are left out. Rows of one key are documents of their own; queries of one key are read as
    one, their texts together. Extra columns are not read.
    """
    spark = docs.sparkSession
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), "text")
    counted = scratch.keep(source.select("text").mapInArrow(frequencies, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "frequencies")
    total = counted.where("term is null").first()
    n, words = (total["df"], total["words"]) if total else (0, 0)
    asked = queries.where(F.col(query_key).isNotNull()).select(F.col(query_key).cast("long").alias("query_id"), "text")
    asked = asked.mapInArrow(_terms, "query_id long, term long, n long")
    # a query in several rows is one: each of its terms once
    asked = asked.groupBy("query_id", "term").agg(F.sum("n").alias("n"))
    weighed = asked.join(counted.where("term is not null"), "term").withColumn("weight", F.col("n") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    packed = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))
    kept = scratch.keep(packed.select("query_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "queries")
    files = sorted(kept.inputFiles())
    block, shard_docs = BLOCK, SHARD_DOCS
    found = source.mapInArrow(lambda b: _search(b, files, max(words, 1) / max(n, 1), k, block, shard_docs), "query_id long, doc_id long, score double")
    return found.selectExpr("query_id", "cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) as int) AS rank", "doc_id", "score").where(f"rank <= {k}")
