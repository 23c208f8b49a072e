"""Steps whose cost has to follow the input: plans and small cases of what failed on larger tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from resona import catalogue
from tests.test_queries import plan


@pytest.mark.parametrize("name", ["sideband_match", "harmonic_match"])
def test_targets_are_not_broadcast(spark, sf_dir, name):
    assert "Broadcast" not in plan(catalogue.QUERIES[name](spark, sf_dir))


def test_sparse_sums_are_made_where_documents_lie(spark, sf_dir):
    import re

    text = plan(catalogue.QUERIES["sparse_bm25_topk"](spark, sf_dir))
    assert "Bucketed: true" in text and "SortMergeJoin" not in text
    assert not re.search(r"hashpartitioning\((query_id|id|term)#\d+L?, (query_id|id)#", text)


def test_sparse_search_in_blocks_of_queries(spark, monkeypatch):
    from resona.operators import retrieval as ret

    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 17}" for j in range(1, 9))) for k in range(60)], "id long, text string")
    asked = docs.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    whole = sorted(ret.bm25_top_k(docs, asked, 4).collect())
    monkeypatch.setattr(ret, "SPARSE_BLOCK", 3)
    monkeypatch.setattr(ret, "SUMS", 20)
    cut = ret.bm25_top_k(docs, asked, 4)
    assert sorted(cut.collect()) == whole and len(whole) == 48
    assert "Union" in plan(cut)  # a pass for each block


def test_expected_pairs_are_judged_where_documents_lie(spark, sf_dir):
    """Documents are cut into terms once, and only results are shuffled by query and document."""
    import re

    text = plan(catalogue.QUERIES["visual_recall"](spark, sf_dir)).split("== Physical Plan ==")[1]
    wanted, found = text.split("count(distinct CASE", 1)
    assert "documents.parquet" not in text and "Bucketed: true" in wanted and "Bucketed: true" in found
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", wanted)
    assert re.search(r"BroadcastHashJoin \[query_id#\d+L?, id#\d+L?\].* LeftSemi", found)  # what is shuffled by both is no more than the results


def test_ranking_metrics_of_repeats(spark):
    from resona.operators import retrieval as ret

    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3), (1, 12, 4), (2, 10, 1), (4, 10, 1)], "query_id long, id long, rank int")
    expected = spark.createDataFrame([(1, 10), (1, 10), (1, 12), (1, 13), (2, 11), (3, 10), (3, None)], "query_id long, id long")
    got = {r.query_id: (round(r.recall, 6), round(r.precision, 6), r.hit, r.mrr) for r in ret.ranking_metrics(results, expected, 3).collect()}
    assert got == {1: (0.333333, 0.333333, 1.0, 1.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0, 0.0)}


def test_small_recordings_share_a_partition(spark, tmp_path):
    from resona.sources import recordings as rec

    signal = spark.range(900).selectExpr("id div 3 as signal_id", "'view' as channel", "id % 3 as i", "id * 0.5 as x")
    rec.write_wav(signal, str(tmp_path / "wav"), 2000.0).count()
    (tmp_path / "wav" / "bad.wav").write_bytes(b"RIFF")
    read = rec.load(spark, f"file://{tmp_path}/wav")
    assert read.rdd.getNumPartitions() == 1
    assert read.where("problem is not null").count() == 1
    got = read.where("problem is null").selectExpr("count(*)", "count(distinct path)", "sum(x)").first()
    assert tuple(got) == (900, 300, 899 * 900 / 4)


def test_grades_of_events_are_exact(spark, tmp_path):
    """29 of 200 and the like are no ties of doubles, sums don't depend on the order of rows, and both engines say the same."""
    import random

    import duckdb

    rows, rng = [], random.Random(1)
    for user in range(60):
        for n, high, kind in ((200, 29, "view"), (200, 57 + user % 3 * 4, "error"), (40, 3, "login")):
            rows += [(user, kind, 10.01 + rng.randrange(100) / 100 if k < high else rng.randrange(1000) / 100) for k in range(n)]
    for user in range(60, 90):  # means of exactly 5 and 7.5, in many orders
        for kind, far in (("view", 2.5), ("error", 0.0)):
            for k in range(24):
                gap = rng.randrange(1, 500) / 100
                rows += [(user, kind, round(5 + far + gap, 2)), (user, kind, round(5 + far - gap, 2))]
    rng.shuffle(rows)
    events = [(4 * k, *r) for k, r in enumerate(rows)]  # one fault of localize_fault
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("primary_fault_rank", "localize_fault"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), name
        if name == "localize_fault":
            assert {tuple(r) for r in got.where("signal_id >= 60").select("verdict", "dominant_channel", "ratio").collect()} == {("dominant", "view", 1.5)}


def test_versions_of_counts_read_texts_once(spark, monkeypatch):
    import public_tokenizers

    from resona.llm import scratch, token_counts

    kept, keep = [], scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, *a: kept.append(plan(df)) or keep(df, *a))
    monkeypatch.setattr(token_counts.scratch, "keep", scratch.keep)
    docs = spark.createDataFrame([(k, "s", "en", "some words " * k) for k in range(20)], "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(20)], "doc_id long, quality int, toxic int")
    files = [(n, public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k")]
    totals = {r.tokenizer: r.docs for r in token_counts.token_counts(docs, labels, *files).collect()}
    assert totals == {"byte_bpe_50k": 7, "word_bpe_49k": 7}
    assert not any("Join" in p for p in kept)  # texts never meet the labels


def test_new_version_counts_few_others(spark, monkeypatch):
    """The new version counts the documents of low quality, null ids and repeats too, and hardly any other; totals are as if it counted all."""
    import public_tokenizers

    from resona.llm import scratch, token_counts

    kept, keep = {}, scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    rows = [(k if k % 50 else None, "s", None, f"some words {k} " * (k % 7)) for k in range(-300, 300)] + [(7, "s", None, "again"), (14, "s", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(k, int(k % 7 > 0), 0) for k in range(-300, 300)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    files = [(n, public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k")]
    totals = {r.tokenizer: (r.docs, r.tokens) for r in token_counts.token_counts(docs, labels, *files).collect()}
    low = lambda k: k is not None and k % 7 == 0
    counted = token_counts.token_numbers(docs, files[0][1], files[1][1]).collect()
    want = [(sum(low(r.doc_id) == new for r in counted), sum(r.tokens2 if new else r.tokens for r in counted if low(r.doc_id) == new)) for new in (False, True)]
    assert [totals[n] for n, _ in files] == want
    assert 0 < kept["counted"].where("tokens2 is not null").count() - want[1][0] < 60


def test_marks(spark):
    from resona.llm import token_counts as tc

    bitmap, power = tc.marks(spark.range(-500, 5000).toDF("k"))
    assert power == 17 and len(bitmap) == 1 << 14
    bits = [r[0] for r in spark.range(-500, 25000).select(tc.mark(F.col("id"), power)).collect()]
    seen = [int(bitmap[b >> 3]) >> (b & 7) & 1 for b in bits]
    assert all(seen[:5500]) and sum(seen[5500:]) < 2000
    assert not tc.marks(spark.range(0).toDF("k"))[0].any()


def test_folds_are_dealt_over_tasks(spark, monkeypatch):
    """Features of texts are made by all tasks, each fold's once, and rows have the folds that one numbering of a class gives."""
    import random

    from pyspark.sql import Window

    from resona.operators import complexity as cx
    from resona.sources import held
    from tests.test_complexity import queries

    labelled = spark.createDataFrame(queries(random.Random(2), 200) + [(900, None, "show")], "id long, label int, text string")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    want = labelled.withColumn("fold", F.row_number().over(order) % 3)
    assert sorted(map(str, cx.folds(labelled, 3).collect())) == sorted(map(str, want.collect()))
    parts, write = {}, held.held
    monkeypatch.setattr(held, "held", lambda df, name: parts.setdefault(name, []).append(df.rdd.getNumPartitions()) or write(df, name))
    assert cx.cross_validate(labelled.where("label is not null"), ["bearing"], 2, 2).count() == 5
    assert parts["folds"] == [spark.sparkContext.defaultParallelism] and len(parts["features"]) == 2


def test_prefix_is_no_estimate(spark, monkeypatch):
    """The join's prefix follows from threshold and recall alone: nothing is measured on a sample of the documents."""
    from resona.llm import ngram_join as nj
    from resona.llm import scratch

    kept, keep = [], scratch.keep
    monkeypatch.setattr(nj.scratch, "keep", lambda df, name: kept.append(name) or keep(df, name))
    words = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:290], *"abcdefghij"])), (2, " ".join(words[::-1])), (3, None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0)} and "probes" not in kept
    assert [nj.settled(t, 0.9995) for t in (0.8, 0.9)] == [4, 8] and nj.found_at(0.8, 4, nj.agreement(0.8)) >= 0.9995 > nj.found_at(0.8, 5, nj.agreement(0.8))


def test_records_of_one_length_are_analysed_together(spark, monkeypatch):
    """A task calls the kernels once for all its records of a length, and each record has the very result that it has alone."""
    import numpy as np

    from resona.operators import kernels as k

    rng = np.random.default_rng(3)
    records = [rng.normal(size=n) for n in (13, 14, 9, 13, 14, 14, 4, 1, 13)]
    signal = spark.createDataFrame([(s, "a", i, float(v)) for s, x in enumerate(records) for i, v in enumerate(x)], "signal_id long, channel string, i long, x double")
    want = {s: k.best_bands(x[None], 1000.0)[0] for s, x in enumerate(records)}
    assert {r.signal_id: (r.f_lo, r.f_hi, r.reliable) for r in k.bands(signal, 1000.0).collect()} == want
    calls, reliable = [], k.reliable
    monkeypatch.setattr(k, "reliable", lambda x, *a, **b: calls.append(x.shape) or reliable(x, *a, **b))
    got = {}
    for places, x in k.together(records, lambda at: None):
        got |= zip(places, k.best_bands(x, 1000.0), strict=True)
    assert got == want and sorted(calls) == [(1, 9), (3, 13), (3, 14)]  # shorter ones have no band
    alone = {at: m.tolist() for at in range(9) for _, _, m in k.envelope_spectra(records[at : at + 1], [1000.0], [25.0], [400.0])}
    assert {at: m.tolist() for at, _, m in k.envelope_spectra(records, [1000.0] * 9, [25.0] * 9, [400.0] * 9)} == alone and len(alone) == 7
    assert [x.shape for _, x in k.together(records, lambda at: None, 28)] == [(2, 13), (1, 13), (2, 14), (1, 14), (1, 9), (1, 4), (1, 1)]


def test_likeness_keeps_words_of_the_other_side_only(spark, monkeypatch):
    """Words that no text has are not kept; the pairs are those of a comparison of all."""
    import random

    from resona.operators import retrieval as ret

    kept, held = [], ret.held
    monkeypatch.setattr(ret, "held", lambda df, name: kept.append((name, held(df, name))) or kept[-1][1])
    rng = random.Random(4)
    right = {k: rng.sample([f"w{i}" for i in range(30)], rng.randint(1, 12)) for k in range(25)} | {90: []}
    left = {k: rng.sample(w, rng.randint(1, len(w))) + [f"own{k}.{i}" for i in range(rng.randint(0, 6))] for k, w in enumerate(list(right.values())[:25] * 4)} | {200: [], 201: ["alone"]}
    of = lambda sets: spark.createDataFrame(list(sets.items()), "key long, w array<string>")
    for least in (0.4, 0.75, 1.0):
        kept.clear()
        got = sorted(map(tuple, ret.like_pairs(of(left), of(right), least).collect()))
        want = sorted((a, b) for a, x in left.items() for b, y in right.items() if (c := len({*x} & {*y})) and c >= least * (len(x) + len(y) - c))
        assert got == want and want
        words = {w for name, df in kept if name == "word-sets" for r in df.collect() for w in r.w}
        assert words and words <= {w for y in right.values() for w in y}


def test_rules_on_text_run_in_all_tasks(spark, sf_dir):
    """A file of one row group is one task; its texts are dealt out before the rules."""
    read = catalogue.QUERIES["negation_flags"](spark, sf_dir)
    assert spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions() == 1
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and "Exchange" in plan(read)


def test_searches_keep_thresholds_between_shards():
    """Shards of some documents, in blocks, give what brute force gives for all, and an earlier shard's k-th scores leave out what can't be among the best."""
    import numpy as np

    from resona.operators import postings

    rng = np.random.default_rng(5)
    n, k, words = 700, 5, 400
    rows = [np.unique(np.append(rng.choice(words, rng.integers(1, 40), p=(p := 1 / np.arange(1.0, words + 1)) / p.sum()), [words + i] if i % 3 else [])) for i in range(n)]
    rows[600:] = rows[:100]  # ties
    docs, terms = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows).astype(np.uint64)
    impact, value = rng.random(words + n)[terms.astype(int)] + 0.1, rng.random(words + n)
    asked = [rows[i].astype(np.uint64) for i in (0, 7, 55, 301)] + [np.array([9 << 40], np.uint64), np.zeros(0, np.uint64), np.arange(words + n, dtype=np.uint64)]
    weights = [value[np.minimum(q, words + n - 1).astype(int)] + 0.01 for q in asked]
    at = np.cumsum([0, *map(len, asked)])
    score = np.zeros((len(asked), n))
    for i, (q, w) in enumerate(zip(asked, weights, strict=True)):
        np.add.at(score[i], docs, np.where(np.isin(terms, q), weight_of(q, w, terms) * impact, 0.0))
    want = [sorted((-round(s, 6), 10 * d) for d, s in enumerate(row) if s > 0)[:k] for row in score]
    for step, block in ((700, 8192), (90, 16), (333, 50)):
        least, found, rows_out = np.zeros(len(asked)), [[] for _ in asked], 0
        for lo in range(0, n, step):
            some = (docs >= lo) & (docs < lo + step)
            ids = 10 * np.arange(lo, min(n, lo + step))
            shard = postings.Shard(ids, docs[some] - lo, terms[some], impact[some], np.bincount(docs[some] - lo, minlength=len(ids)), block)
            for q, d, s in zip(*shard.search(at, np.concatenate(asked), np.concatenate(weights), least, k), strict=True):
                found[q].append((-s, d))
                rows_out += 1
        for got, full in zip(found, want, strict=True):
            got = sorted(got)[:k]
            assert [d for _, d in got] == [d for _, d in full] and [s for s, _ in got] == pytest.approx([s for s, _ in full], abs=1.1e-6)
        assert least[0] == pytest.approx(-want[0][-1][0], abs=1.1e-6) or step < n
        assert rows_out < len(asked) * k * -(-n // step) * (0.6 if step < 200 else 1.01)


def weight_of(names, values, terms):
    import numpy as np

    at = np.searchsorted(names, terms)
    return np.where(at < len(names), np.append(values, 0.0)[np.minimum(at, len(names))], 0.0)


def test_blocks_of_others_are_not_scored(monkeypatch):
    import numpy as np

    from resona.operators import postings

    docs = np.repeat(np.arange(40), 3)
    terms = np.concatenate([[i % 2 * 10, i % 2 * 10 + 1, 100 + i] for i in range(40)]).astype(np.uint64)  # two languages
    shard = postings.Shard(np.arange(40), docs, terms, np.ones(120), np.full(40, 3), 10)
    scored, scores = [], postings.Shard._scores
    monkeypatch.setattr(postings.Shard, "_scores", lambda self, b, *a: scored.append(b) or scores(self, b, *a))
    _, ids, _ = shard.search(np.array([0, 3]), np.array([0, 1, 104], np.uint64), np.ones(3), np.zeros(1), 1)
    assert ids.tolist() == [4] and len(scored) == 1


def test_ngrams_as_hashes(spark):
    """A text's distinct n-grams and their counts, and those that texts share, are the ones that the model's stages make as strings."""
    from collections import Counter

    import pyarrow as pa

    from resona.operators import complexity as cx
    from resona.operators import ngrams

    texts = ["fan x belt  hum", "", "a", " hum belt\tfan\n", "aaaa aaaa aaaa", "çığ İç \U0001f600\U0001f600 b_1 x-y", "fan x belt  hum", "  ", "hum hum"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    for stage, kind in ((cx.WordNGrams, "words"), (cx.CharNGrams, "chars")):
        want = [Counter(r.o) for r in stage(inputCol="text", outputCol="o").transform(df).orderBy("id").collect()]
        words = [r.w for r in df.orderBy("id").selectExpr(rf"transform(regexp_extract_all(text, r'{cx.WORD}', 0), w -> xxhash64(w)) as w").collect()]
        spaced = [r.s for r in df.orderBy("id").selectExpr(r"concat(' ', regexp_replace(text, r'(?U)\s+', '  '), ' ') as s").collect()]
        at, terms, counts = ngrams.counted(pa.array(words, pa.list_(pa.int64())), pa.array(spaced))[kind]
        got = [Counter(dict(zip(terms[at == i].tolist(), counts[at == i].tolist(), strict=True))) for i in range(len(texts))]
        assert [sorted(c.values()) for c in got] == [sorted(c.values()) for c in want]
        assert [[len(a & b) for b in got] for a in got] == [[len(a & b) for b in want] for a in want]


def test_folds_count_ngrams_once(spark, monkeypatch):
    """All folds share one count of n-grams, and their figures are those of the model's own stages."""
    import random

    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from resona.operators import complexity as cx
    from resona.operators import ngrams
    from resona.sources import held
    from tests.test_complexity import queries

    rng = random.Random(4)
    labelled = spark.createDataFrame([(i, label if rng.random() < 0.8 else 1 - label, text) for i, label, text in queries(rng, 150)], "id long, label int, text string")
    kept, write = [], held.held
    monkeypatch.setattr(held, "held", lambda df, name: kept.append(name) or write(df, name))
    got = {r.metric: (r["mean"], r.spread) for r in cx.cross_validate(labelled, ["bearing"], 2, 5).collect()}
    assert kept.count("vocabulary") == 1 and kept.count("folds") == 1
    rows = Pipeline(stages=cx.shaping(["bearing"])).fit(labelled).transform(cx.folds(labelled, 2)).cache()
    parts = [Pipeline(stages=cx.learning(rows.where(f"fold <> {k}").count(), 5)).fit(rows.where(f"fold <> {k}")).transform(rows.where(f"fold = {k}")) for k in range(2)]
    want = cx.summary(parts[0].unionByName(parts[1]).select("fold", "id", "label", vector_to_array("probability")[1].alias("p")))
    assert got == {r.metric: (pytest.approx(r["mean"]), pytest.approx(r.spread)) for r in want.collect()}
    assert ngrams.KINDS == ("words", "chars")


def test_whole_texts_as_queries(spark):
    """The same rows as by joins on terms; terms that a query repeats count once, and a document without an id only counts in the statistics."""
    import random

    from resona.operators import retrieval as ret

    rng = random.Random(7)
    text = lambda i: " ".join(rng.choices(["The", "and", "çok", "of", f"own{i % 9}", f"rare{i}", "x-1"], k=rng.randrange(1, 30)))
    rows = [(3 * i, text(i)) for i in range(150)] + [(1000, None), (1001, "..."), (1002, "unlike")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    asked = docs.where("id % 9 = 0 or id > 999").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, ret.bm25_top_k(docs, asked, 6).select("query_id", "id", "score", "rank").collect()))
    got = ret.bm25_of_texts(docs, asked.unionByName(asked.limit(5)), 6)
    assert sorted(map(tuple, got.select("query_id", "id", "score", "rank").collect())) == want and len(want) > 250
    extra = docs.unionByName(spark.createDataFrame([(None, "own1 unlike of"), (None, None)], docs.schema))
    some = ret.bm25_of_texts(extra, asked, 6)
    named = docs.unionByName(spark.createDataFrame([(-1, "own1 unlike of"), (-2, None)], docs.schema))
    full = [r for r in ret.bm25_top_k(named, asked, 8).select("query_id", "id", "score").collect() if r.id >= 0]
    score = {(r.query_id, r.id): r.score for r in full}
    assert all(r.id is not None and score.get((r.query_id, r.id), r.score) == r.score for r in some.collect())
    assert {(r.query_id, r.id) for r in some.where("query_id = 1002").collect()} == {(1002, 1002)}
    assert ret.bm25_of_texts(docs, asked.limit(0), 3).count() == 0 and ret.bm25_of_texts(docs.limit(0), asked, 3).count() == 0


@pytest.mark.parametrize("name", ["hybrid_search", "hybrid_rerank"])
def test_hybrid_search_makes_no_pairs_by_joins(spark, sf_dir, name):
    """Whole texts are compared in shards: no pass over counted documents for each block of queries, and no pair but a task's best."""
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert "Bucketed: true" not in text and "inline" not in text and "tf#" not in text
