"""Classifier, token store, search, WARC, mixing, counts, decontamination and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resona.llm import decontaminate as dec
from resona.llm import mixing, quality, scratch, token_counts, token_store, topk_search, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


# op2


def graded(rng, n):
    good, bad = [f"w{k}" for k in range(300)], ["vile", "nasty", "awful"]
    out = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2])
        words = [rng.choice(good) for _ in range(rng.randint(5, 80))]
        if grade == 0:
            words += rng.sample(bad, 2)
        out.append((i, " ".join(w + "!!" * (grade == 1) for w in words), grade))
    return out


def test_classifier_held_out(spark):
    rows = graded(random.Random(1), 1500)
    docs = spark.createDataFrame([(i, t, 5.0) for i, t, _ in rows] + [(9000, None, None), (9001, "", 1.0), (None, "w1", 1.0)], "doc_id long, text string, expected_grade double")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows[:1000]] + [(None, 1), (3, None), (8888, 2)], "doc_id long, grade int")
    model = quality.train(docs, labels, F.col("grade"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    again = quality.train(docs.repartition(7), labels, F.col("grade"), 3)
    assert np.allclose(model.weights, again.weights)
    out = quality.score(docs, model, 2)
    assert Counter(out.columns) == Counter(["doc_id", "text", "expected_grade", "tail_probability"])
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 1503
    right = sum((got[i].tail_probability >= 0.5) == (g == 2) for i, _, g in rows[1000:])
    assert right / 500 > 0.97
    assert np.mean([got[i].expected_grade for i, _, g in rows[1000:] if g == 0]) < np.mean([got[i].expected_grade for i, _, g in rows[1000:] if g == 1]) < 1.5
    assert got[9000].tail_probability == got[9001].tail_probability
    bounded = quality.train(docs, labels, F.col("grade"), 3, sample=50)
    assert bounded.thresholds.shape == (2,)


def test_fit_is_the_optimum_of_the_likelihood():
    rng = np.random.default_rng(4)
    n, grades, decay = 60, 3, 2e-4
    grade = rng.integers(0, grades, n)
    held = [np.flatnonzero((grade >= g) ^ (rng.random(n) < 0.2)) for g in range(1, grades)]
    doc, column = np.concatenate(held), np.repeat([0, 1], [*map(len, held)])

    def value(x):  # P(grade <= k) = sigmoid(threshold_k - w.x), spelt out
        cuts = [x[2], x[2] + math.exp(x[3])]
        out = -decay / 2 * (x[0] ** 2 + x[1] ** 2)
        for i in range(n):
            eta = sum(x[c] for d, c in zip(doc, column, strict=True) if d == i)
            upto = [0.0, *(1 / (1 + math.exp(eta - c)) for c in cuts), 1.0]
            out += math.log(upto[grade[i] + 1] - upto[grade[i]]) / n
        return out

    def by_differences(x):
        return np.array([(value(x + e) - value(x - e)) / 2e-5 for e in np.eye(4) * 1e-5])

    x = np.array([0.3, -0.2, -0.5, 0.1])
    assert quality.slopes(x, doc, column, grade, grades, decay) == pytest.approx(by_differences(x), abs=1e-6)
    model = quality.fit(doc, column, grade, grades, z=0.0, decay=decay, steps=3000)
    found = np.array([*model.weights[:2], model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])])
    assert np.abs(by_differences(found)).max() < 2e-3


def test_repeated_documents_and_long_texts(spark):
    rows = [(i % 50, "w " * 30_000 if i == 7 else f"w{i}") for i in range(200)] + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rated", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 3) for i in range(50)], "doc_id long, grade int")
    a, b = (quality.train(d, labels, F.col("grade"), 3) for d in (docs, docs.repartition(5)))
    assert (a.thresholds == b.thresholds).all() and not a.informed
    assert quality.score(docs, a, 2).select("tail_probability").distinct().count() == 1


def test_classifier_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"), F.col("grade"), 3)
    assert quality.score(docs, model, 2).count() == 0


# op3


def test_token_store(spark, make_docs, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    docs = make_docs(corpus)
    got = token_store.token_store(docs, BPE, 2).collect()
    assert len(got) == len(corpus)
    start = 0
    by_key = Counter()
    found = {(r.doc_id, r.ordinal): r for r in got}
    for i, t in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        r = found[i, by_key[i]]
        by_key[i] += 1
        assert (r.start, r.n_tokens) == (start, len(ids)) and bytes(r.ids) == ids.tobytes()
        start += len(ids)


def test_token_store_look_up(spark, make_docs, corpus):
    folder = scratch.folder(spark, "t")
    token_store.write_tokens(make_docs(corpus), folder, BPE, 2, shard_bytes=500, bucket_keys=3)
    keys = spark.createDataFrame([(0,), (58,), (999,), (-7,)], "doc_id long")
    got = token_store.read_tokens(spark, folder, keys, BPE).collect()
    assert sorted((r.doc_id, r.ordinal) for r in got) == [(-7, 0), (0, 0), (58, 0)]
    assert token_store.token_store(make_docs([]), BPE).count() == 0


def test_perfect_hash():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    hashes[1] = hashes[0] + np.uint64(1)
    levels, slots = token_store.build_index(hashes)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (token_store.Slots.of(levels, np.zeros(0, np.uint64)).find(hashes) == slots).all()
    same = np.array([7, 7], np.uint64)
    levels, slots = token_store.build_index(same)
    assert sorted(slots.tolist()) == [0, 1]
    assert token_store.Slots.of(levels, same).find(np.array([7, 8], np.uint64)).tolist() in ([0, -1], [0, 0], [0, 1])


def test_one_key_over_several_partitions(spark):
    rng = random.Random(8)
    rows = [(None if i % 2 else i % 40 and 3, "".join(rng.choice("abcdef ") for _ in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = scratch.folder(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_store.write_tokens(docs, folder, BPE, 2, shard_bytes=500)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    entries = spark.read.schema(token_store.ENTRY).parquet(f"{folder}/entries")
    assert entries.where("no_key").select(F.shiftright("shard", token_store.PART_BITS)).distinct().count() > 1
    got = {(r.doc_id, r.ordinal): r for r in token_store.read_tokens(spark, folder, docs, BPE).collect()}
    assert len(got) == 300
    from tokenizers import Tokenizer

    library, start, seen = Tokenizer.from_file(BPE), 0, Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        r = got[i, seen[i]]
        seen[i] += 1
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == (start, ids)
        start += len(ids)


def test_tokenizer_that_is_not_cut(tmp_path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(BPE)
    other.normalizer = normalizers.Lowercase()
    other.save(str(tmp_path / "lower.json"))
    e = token_store.Encoder(str(tmp_path / "lower.json"), 2)
    assert not e.cuttable
    assert np.frombuffer(e.encode(pa.array(["Some Words, and"]))[0], e.kind).tolist() == other.encode("Some Words, and").ids + [2]


def test_encoder_pieces():
    rng = random.Random(2)
    texts = ["", " ", "a  b\n c", "<|endoftext|> x", "\x1c x!", "a\r\n\r\n b", None] + ["".join(rng.choice(" \n\ta1é!'\x1c​᠎　st") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    e = token_store.Encoder(BPE, 2)
    for _ in range(2):
        got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(pa.array(texts))]
        assert got == [e.library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(BPE)
    texts = ["<|endoftext|> x", "a <|endoftext|>b\n<|endoftext|>", "a  <|endoftext|>", "<|endoftext|", " |> x", "plain text x", None]
    e = token_store.Encoder(BPE, 2)
    for _ in range(2):
        got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(pa.array(texts))]
        assert got == [fresh.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert got[0][0] == 50256


# op4


def bm25(rows, queries, k):
    terms = [re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) for _, t in rows]
    n, mean = len(rows), max(1, sum(map(len, terms))) / max(1, len(rows))
    df = Counter(w for t in terms for w in set(t))
    out = []
    for q, text in queries:
        scores = []
        for (i, _), own in zip(rows, map(Counter, terms), strict=True):
            size = sum(own.values())
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own[w] * 2.2 / (own[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, c in Counter(re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))).items() if own[w])
            if s > 0:
                scores.append((-round(s, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, make_docs, corpus, small, monkeypatch):
    if small:  # many shards and blocks
        monkeypatch.setattr(topk_search, "BLOCK", 2)
        monkeypatch.setattr(topk_search, "SHARD_DOCS", 5)
    rows = [r for r in corpus if r[0] is not None]
    asked = [(i, t) for i, t in rows if i in (0, 30, 40, 51, 50, 53, 55, 57)] + [(777, "zzzz")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in topk_search.top_k(make_docs(corpus), queries, 7).collect())
    want = sorted(bm25(rows, asked, 7))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)
    ties = Counter((q, round(s, 4)) for q, _, _, s in want)
    assert [x[2] for x in got if ties[x[0], round(x[3], 4)] == 1] == [x[2] for x in want if ties[x[0], round(x[3], 4)] == 1]


def test_top_k_of_a_query_in_several_rows(spark, make_docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "and", "of", f"own{i % 7}", f"rare{i}"], k=30))) for i in range(60)]
    asked = [(1, "the own1"), (1, "the and rare5"), (1, "the the of own1"), (2, "and")]
    together = [(1, "the own1 the and rare5 the the of own1"), (2, "and")]
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in topk_search.top_k(make_docs(rows), spark.createDataFrame(asked, "query_id long, text string").repartition(3), 10).collect())
    want = sorted(bm25(rows, together, 10))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)


def test_top_k_empty(spark, make_docs):
    none = spark.createDataFrame([], "query_id long, text string")
    assert topk_search.top_k(make_docs([]), none, 3).count() == 0
    assert topk_search.top_k(make_docs([(1, "a")]), none, 3).count() == 0


# op5


def test_warc_round_trip(spark):
    html = [None, "", "abc", "é" * 30_000, "x" * 200_000, "\r\n0\r\n\r\n"]
    rows = [(i, None if i % 7 == 0 else f"http://a/{i}\nb", html[i % 6], "z") for i in range(60)] + [(5, "again", html[5], "z"), (None, "n", "abc", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.warc_round_trip(pages).collect()), key=str)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        head = i is None or first[h or ""] == i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if head else "revisit", None if head else first[h or ""], data if head else None))
    assert got == sorted(want, key=str)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_revisits_name_a_record_that_is_there(spark):
    pages = spark.createDataFrame([(i, "u", "same " * (9000 if i % 2 else 1)) for i in range(12)] + [(20, "u", "twice"), (20, "u", "twice"), (21, "u", "twice")], "page_id long, url string, html string")
    folder = scratch.folder(spark, "warc")
    rows = warc.read_records(spark, folder, warc.write_warc(pages, folder)).collect()
    names = Counter(r.record_id for r in rows)
    assert max(names.values()) == 1
    assert all(r.refers in names for r in rows if r.refers and r.refers != "urn:page:20")
    assert Counter(r.kind for r in rows)["revisit"] == 11


def test_least_size_for_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.warc_round_trip(pages, least=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_broken_segments():
    block = warc.HEAD + warc.chunked(b"q" * 50_000)
    assert warc.dechunked(block[len(warc.HEAD) :]) == b"q" * 50_000
    rows = [{"origin": "o", "segment": k, "total": None, "block": block[a:b]} for k, (a, b) in enumerate([(0, 20_000), (20_000, 40_000), (40_000, len(block))], 1)]
    rows[-1]["total"] = len(block)
    for r in rows:
        r |= dict.fromkeys(warc.NAMES, "n")
    assert warc._joined(rows).column("payload_bytes")[0].as_py() == 50_000
    with pytest.raises(ValueError, match="whole record"):
        warc._joined([rows[0], rows[2]])
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parsed(warc.record({"WARC-Record-ID": "<x>"}, b"a")[:-12]))


# op6


def test_mixing(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(20, 60), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(5000, None, "void"), (5001, "", None), (5002, "abc", None), (None, "n", "hot"), (7, "same", "s1"), (7, "same", "s1")]
    docs = make_docs(rows)
    rates = {r.source: r for r in mixing.rates(docs).collect()}
    assert sum(r.weight for r in rates.values()) == pytest.approx(1)
    assert rates["void"].rate == 1 and set(rates) == {s for _, _, s in rows}
    out = mixing.mix(docs)
    assert sorted(out.columns) == sorted([*(c for c in docs.columns if c not in ("replica", "place")), "replica", "place"])
    got = out.collect()
    again = sorted((str(r.doc_id), r.replica, r.place) for r in mixing.mix(docs.repartition(9)).collect())
    assert again == sorted((str(r.doc_id), r.replica, r.place) for r in got)
    places = [r.place for r in got]
    assert places == sorted(places)
    runs = [r.doc_id for r in got if r.doc_id is not None]
    assert abs(np.corrcoef(runs, np.arange(len(runs)))[0, 1]) < 0.1
    chars = Counter()
    for r in got:
        chars[r.source] += len(r.text or "")
    total = sum(len(t or "") for _, t, _ in rows)
    assert sum(chars.values()) == pytest.approx(total, rel=0.1)
    assert chars["hot"] / sum(chars.values()) == pytest.approx(rates["hot"].weight, rel=0.1)
    assert mixing.mix(make_docs([])).count() == 0


def test_mixing_to_given_weights(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(20, 60), "abc"[i % 3]) for i in range(3000)] + [(9000 + i, "y" * 40, None) for i in range(300)] + [(9999, None, "empty")]
    weights = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), (None, 1.0), ("gone", 5.0), ("empty", 3.0)], "source string, weight double")
    got = Counter()
    for r in mixing.mix(make_docs(rows), weights=weights).collect():
        got[r.source] += len(r.text or "")
    total = sum(got.values())
    assert got["c"] == 0 and total == pytest.approx(sum(len(t or "") for _, t, _ in rows), rel=0.1)
    assert [got[s] / total for s in ("a", "b", None)] == pytest.approx([0.5, 0.25, 0.25], rel=0.15)
    assert mixing.mix(make_docs([]), weights=weights).count() == 0


def test_poisson_inversion(spark):
    table = mixing.rates(spark.createDataFrame([("a", "x" * 50), ("b", "y")], "source string, text string")).collect()
    for r in table:
        p = [math.exp(-r.rate) * r.rate**k / math.factorial(k) for k in range(len(r.cdf))]
        assert r.cdf == pytest.approx(np.cumsum(p).tolist())


def test_mixing_query_moves_whole_rows(spark, sf_dir):
    from resona.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.op6_mixing(spark, sf_dir)
    written = spark.read.parquet(*out.inputFiles())
    assert set(docs.columns) < set(written.columns)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = written.collect()
    assert all(r.text == texts[r.doc_id] for r in rows)
    assert Counter((r.doc_id, r.replica, round(r.place, 9)) for r in rows) == Counter((r.doc_id, r.replica, r.place) for r in out.collect())


def test_rates_have_no_limit(spark, make_docs):
    docs = make_docs([(1, "x" * 2_000_000, "hot")] + [(10 + i, "y", f"rare{i}") for i in range(40)])
    rates = {r.source: r for r in mixing.rates(docs).collect()}
    rate = 2_000_040 / (2_000_000**0.7 + 40)
    assert rates["rare0"].rate == pytest.approx(rate) and rate > 70
    assert max(len(r.cdf) for r in rates.values()) < 200
    got = Counter(r.doc_id for r in mixing.mix(docs).where("source != 'hot'").select("doc_id").collect())
    n = np.array([got[10 + i] for i in range(40)])
    assert abs(n.mean() - rate) < 4 * (rate / 40) ** 0.5
    assert 0.3 * rate < n.var(ddof=1) < 2 * rate


def test_large_rates_do_not_underflow(spark, make_docs):
    docs = make_docs([(10 + i, "y" * 10) for i in range(40)])
    d = math.ceil(2000 / 64)
    mean = 2000 / d
    cdf = np.cumsum([math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(200)]).tolist()
    values = mixing.draws(17, F.col("doc_id"), F.md5(F.col("text").cast("binary")), F.lit(d))
    n = [r.n for r in docs.select(F.aggregate(values, F.lit(0), lambda a, u: a + mixing.counts(u, F.array(*map(F.lit, cdf)))).alias("n")).collect()]
    assert abs(np.mean(n) - 2000) < 4 * (2000 / 40) ** 0.5 and np.var(n) < 4500


# op7


def test_rollup(spark):
    rollup = token_counts.Rollup(spark, scratch.folder(spark, "rollup"))
    assert rollup.totals().count() == 0 and not rollup.merge()
    docs = spark.createDataFrame([("a", "en", 2), ("a", "en", None), (None, None, 1), ("a", "en", 2)], "source string, lang string, tokens long")
    n = F.col("tokens")
    assert rollup.commit("1", token_counts.inserts(docs, "v1", n))
    assert not rollup.commit("1", token_counts.inserts(docs, "v1", n))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "v1", 3, 4), (None, None, "v1", 1, 1)}
    assert rollup.commit("2", token_counts.revisions(docs.where("source is null"), ("v1", n), ("v2", n * 10)))
    assert rollup.merge()
    assert rollup.commit("3", token_counts.deletes(docs.where("tokens is null"), "v1", n))
    assert rollup.commit("4", token_counts.inserts(docs.limit(0), "v1", n))
    assert not rollup.commit("2", token_counts.inserts(docs, "v1", n))
    for _ in range(2):
        assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "v1", 2, 4), (None, None, "v2", 1, 10)}
        assert rollup.merge()


@pytest.mark.parametrize("left", [None, b"", b'{"partial": "par'])
def test_rollup_survives_a_sender_that_dies(spark, left):
    """After its partial, after creating its entry, and amid writing it."""
    folder = scratch.folder(spark, "rollup")
    rollup = token_counts.Rollup(spark, folder)
    docs = spark.createDataFrame([("a", "en", 5), ("b", "de", 7)], "source string, lang string, tokens long")
    changes = token_counts.inserts(docs, "v1", F.col("tokens"))

    class Killed(Exception):
        pass

    def die(name, says):
        if left is not None:
            path, fs = rollup._path(name)
            out = fs.create(path, False)
            out.write(bytearray(left))
            out.close()
        raise Killed

    enter, rollup._enter = rollup._enter, die
    with pytest.raises(Killed):
        rollup.commit("1-x", changes)
    rollup._enter = enter
    assert rollup.commit("1", changes)
    assert rollup.commit("1-x", changes) == (left is None)
    assert sorted(r.tokens for r in rollup.totals().collect()) == [10, 14]
    rollup._enter = die
    with pytest.raises(Killed):
        rollup.merge()
    rollup._enter = enter
    assert sorted(r.tokens for r in rollup.totals().collect()) == [10, 14]
    assert rollup.merge() and sorted(r.tokens for r in rollup.totals().collect()) == [10, 14]


def test_an_entry_without_a_partial_is_an_error(spark):
    rollup = token_counts.Rollup(spark, scratch.folder(spark, "rollup"))
    path, fs = rollup._path("log/1")
    fs.create(path, False).close()
    with pytest.raises(ValueError, match="no partial"):
        rollup.totals()


def test_of_two_senders_of_a_batch_one_commits(spark):
    rollup = token_counts.Rollup(spark, scratch.folder(spark, "rollup"))
    assert [rollup._enter("log/x", {"partial": p}) for p in "ab"] == [True, False]
    assert rollup._entries("log") == {"x": {"partial": "a"}}


def test_token_counts(spark, make_docs, corpus):
    from tokenizers import Tokenizer

    labels = spark.createDataFrame([(0, 1, 1), (20, 0, 0), (30, 0, 1), (None, 0, 1), (1, None, None), (0, 0, 0), (40, 0, 0)], "doc_id long, quality int, toxic int")
    other = public_tokenizers.path("word_bpe_49k.json")
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_counts.token_counts(make_docs(corpus).withColumn("rated", F.lit(1)), labels, ("v1", BPE), ("v2", other)).collect()}
    want = Counter()
    for i, t in corpus:
        if i not in (0, 30):
            name = "v2" if i in (20, 40) else "v1"
            key = ("s0", None if i == 3 else "en", name)
            want[key, 0] += 1
            want[key, 1] += len(Tokenizer.from_file(BPE if name == "v1" else other).encode(t or "", add_special_tokens=False).ids)
    assert got == {k: (want[k, 0], want[k, 1]) for k, _ in want}
    assert token_counts.token_counts(make_docs([]), labels, ("v1", BPE), ("v2", other)).count() == 0


# op8


def edit_search(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers():
    rng = random.Random(6)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (70, 90))
        want = edit_search(p, t)
        assert dec.myers(p, t, 99) == want
        most = rng.randint(0, 8)
        got = dec.myers(p, t, most)
        assert got == want if want <= most else got > most


def test_short_items_are_whole_words(spark, make_docs):
    items = spark.createDataFrame([(1, "hi"), (2, "c++")], "item_id long, text string")
    docs = make_docs([(1, "something"), (2, "well, Hi!"), (3, "hi"), (4, "c++11 or c++"), (5, "hips chi hi"), (6, "x " * 50_000 + "hi")])
    assert {tuple(r) for r in dec.contaminated(docs, items).collect()} == {(2, 1, 0), (3, 1, 0), (4, 2, 0), (5, 1, 0), (6, 1, 0)}


def test_decontamination(spark, make_docs):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 40)))) for k in range(8)] + [(8, "hi"), (9, None), (10, " "), (None, "some words that nobody has"), (3, "a second text of item three is here")]
    rows = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            item = list(items[i % 8][1])
            for _ in range(i % 7):
                item[rng.randrange(len(item))] = rng.choice("xyz")
            body.insert(rng.randint(0, len(body)), "".join(item).upper().replace(" ", "\n  "))
        rows.append((i, " ".join(body)))
    rows += [(90, None), (91, ""), (92, items[0][1] * 3), (92, "x"), (None, items[1][1]), (93, "well hi there")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    docs = make_docs(rows)
    want = {}
    for i, t in rows:
        for k, item in items:
            pattern = dec.plain(item)
            if k is not None and pattern:
                d = edit_search(pattern, dec.plain(t)) if dec.plain(t) else 999
                if d <= len(pattern) // 20:
                    want[i, k] = min(d, want.get((i, k), d))
    assert {(r.doc_id, r.item_id): r.distance for r in dec.contaminated(docs, benchmark).collect()} == want
    clean = dec.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    bad = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted([str(i) for i, _ in rows if i not in bad] + ["92"])
    assert dec.contaminated(make_docs([]), benchmark).count() == 0
    assert dec.decontaminate(docs, benchmark.limit(0)).count() == len(rows)


def test_items_in_several_passes(spark, make_docs, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_CHARS", 30)
    items = spark.createDataFrame([(k, f"item number {k} with words") for k in range(6)], "item_id long, text string")
    docs = make_docs([(k, f"so item number {k} with words it is") for k in range(8)])
    assert {tuple(r) for r in dec.contaminated(docs, items).collect()} == {(k, k, 0) for k in range(6)} | {(k, i, 1) for k in range(8) for i in range(6) if k != i}
    assert dec.decontaminate(docs, items).count() == 0


# the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # under a hundred ratings are too few to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in p.STAGES:
        kept.append(scratch.keep(stage(spark, kept[-1], sf_dir), name))
    for stage in kept[1:-1]:
        assert sorted(stage.columns) == sorted(docs.columns)
    ids = [Counter(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and set(ids[4]) <= set(ids[3])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    toxic = [i for i, r in labels.items() if r.toxic]
    good = [i for i, r in labels.items() if r.quality and not r.toxic]
    assert sum(i in ids[1] for i in toxic) <= 0.35 * len(toxic)
    assert sum(i in ids[1] for i in good) >= 0.9 * len(good)
    items = [dec.plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(any(t in dec.plain(r.text) for t in items) for r in kept[3].collect())
    assert ids[5] == ids[4]
    total = kept[5].agg(F.sum("n_tokens")).first()[0]
    last = kept[5].orderBy(F.desc("start")).first()
    assert last.start + last.n_tokens == total


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(50)) for _ in range(n))
    item, base = words(30), [words(60) for _ in range(6)]
    rows = [(i, t, "en", "s0", len(t), "clash") for i, t in enumerate(base)] + [(10, base[0], "en", "s1", 1, "x"), (10, base[0], "en", "s1", 1, "x"), (None, base[1] + " more", None, None, None, None)]
    rows += [(20, None, None, "s0", None, "x"), (21, "", "en", "s0", 0, "x"), (22, " ", "en", "s0", 1, "x"), (23, words(20) + " " + item, "en", "s0", 9, "x"), (24, words(20_000), "en", "s0", 9, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, replica string"
    spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "x"), (3, " ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        kept = [docs]
        for name, stage in p.STAGES:
            kept.append(scratch.keep(stage(spark, kept[-1], str(tmp_path)), name))
            assert kept[-1].columns == (p.COLUMNS if stage is not p.tokens else ["doc_id", "replica", "start", "n_tokens", "ids_crc32"])
        ids = [sorted(str(r.doc_id) for r in k.select("doc_id").collect()) for k in kept]
        if not some:
            assert not any(ids)
            continue
        assert ids[1] == ids[0]  # under a hundred ratings teach nothing, and nothing is rejected
        assert ids[2] == sorted(map(str, [*range(6), 20, 21, 22, 23, 24]))
        assert ids[3] == [i for i in ids[2] if i != "23"]
        assert ids[5] == ids[4]
        from tokenizers import Tokenizer

        library, texts = Tokenizer.from_file(BPE), {r[0]: r[1] for r in rows}
        start, out = 0, sorted(kept[5].collect(), key=lambda r: r.start)
        for r in out:
            raw = np.array(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
            start += r.n_tokens
        mixed = [r.doc_id for r in mixing.mix(kept[3], p.SEED).collect()]
        assert [r.doc_id for r in out] == mixed
