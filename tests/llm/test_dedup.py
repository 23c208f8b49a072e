"""Substring, suffix-array and near-duplicate operators against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from resona.llm import hashing, scratch
from resona.llm.groups import components, forest
from resona.llm.ngram_join import DEPTH, TREES, agreement, found_at, measured_recall, ngram_join, one_of_each, overlaps
from resona.llm.substring_dedup import expand, squeeze, substring_dedup
from resona.llm.suffix_dedup import minimisers, suffix_dedup


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def windows(rows, width):
    """(words, repeated mask, later mask) of each row in document order."""
    texts = [(t or "").encode().split() for _, t in in_order(rows)]
    seen = Counter(tuple(w[k : k + width]) for w in texts for k in range(len(w) - width + 1))
    before, out = set(), []
    for w in texts:
        again, later = [False] * len(w), [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if seen[key] > 1:
                again[k : k + width] = [True] * width
            if key in before:
                later[k : k + width] = [True] * width
            before.add(key)
        out.append((w, again, later))
    return out


def kept(w, later):
    return b" ".join(x for x, gone in zip(w, later, strict=True) if not gone).decode()


@pytest.mark.parametrize("chunk", [2_000, 1 << 22])
def test_substring_dedup(make_docs, corpus, chunk):
    got = substring_dedup(make_docs(corpus), 20, chunk_bytes=chunk).collect()
    want = [(i, len(w), sum(later), kept(w, later)) for (i, _), (w, _, later) in zip(in_order(corpus), windows(corpus, 20), strict=True)]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_suffix_dedup(make_docs, corpus):
    got = suffix_dedup(make_docs(corpus), 50, chunk_bytes=2_000).collect()
    want = [(i, len(w), sum(again), sum(later), kept(w, later)) for (i, _), (w, again, later) in zip(in_order(corpus), windows(corpus, 50), strict=True) if any(again)]
    assert sorted(((r.doc_id, r.n_words, r.n_repeated, r.n_removed, r.kept) for r in got), key=str) == sorted(want, key=str)


def test_suffix_dedup_of_very_common_passages(make_docs, corpus, monkeypatch):
    monkeypatch.setattr("resona.llm.suffix_dedup.HOT", 3)
    docs = make_docs(corpus)
    got = {(r.doc_id, r.n_words, r.n_repeated, r.n_removed) for r in suffix_dedup(docs, 50).collect()}
    want = {(i, len(w), sum(again), sum(later)) for (i, _), (w, again, later) in zip(in_order(corpus), windows(corpus, 50), strict=True) if any(again)}
    assert got == want


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup, ngram_join, one_of_each])
def test_empty_table(make_docs, op):
    assert op(make_docs([])).collect() == []


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(rows):
    """Number of links and class of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    links, name = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = name[a], name[b]
                name = [x if n == y else n for n in name]
    least = defaultdict(lambda: None)
    for (i, _), n in zip(rows, name, strict=True):
        if i is not None:
            least[n] = i if least[n] is None else min(i, least[n])
    return [(i, least[n], k) for (i, _), n, k in zip(rows, name, links, strict=True)], name


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(make_docs, corpus, small, monkeypatch):
    if small:  # many blocks
        monkeypatch.setattr("resona.llm.ngram_join.BLOCK_CLASSES", 2)
        monkeypatch.setattr("resona.llm.ngram_join.BLOCK_SHINGLES", 200)
    got = ngram_join(make_docs(corpus)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted(groups(corpus)[0], key=str)


@pytest.mark.parametrize("j", [0, 1])
def test_small_tiles(corpus, j, monkeypatch):
    import pyarrow as pa

    from resona.llm import ngram_join as nj

    monkeypatch.setattr(nj, "TILE", 3)
    texts = sorted({t for _, t in corpus if shingles(t)})
    sets = dict(zip(texts, nj.shingle_sets(pa.array(texts)), strict=True))
    node = {nj.digest(s): t for t, s in sets.items()}
    table = pa.record_batch({"cluster": ["c"] * len(node), "node": pa.array(list(node), pa.binary()), "copies": [1 + k % 3 for k in range(len(node))], "i": [0] * len(node), "j": [j] * len(node), "side": [j * (k % 2) for k in range(len(node))], "shingles": pa.array([sets[t].tobytes() for t in node.values()], pa.binary())})
    rows = [{**r, "text": node[r["node"]]} for r in table.to_pylist()]
    near = lambda a, b: a != b and (j == 0 or a["side"] != b["side"]) and len(shingles(a["text"]) & shingles(b["text"])) >= 0.8 * len(shingles(a["text"]) | shingles(b["text"])) - 1e-9
    out = [r for x in nj._verified(iter([table]), 0.8) for r in x.to_pylist()]
    want = {a["node"]: sum(b["copies"] for b in rows if near(a, b)) for a in rows}
    assert {r["a"]: r["links"] for r in out if r["b"] is None} == {n: k for n, k in want.items() if k} != {}
    at = {r["node"]: k for k, r in enumerate(rows)}
    tree = [(at[r["a"]], at[r["b"]]) for r in out if r["b"] is not None]
    true = [(at[a["node"]], at[b["node"]]) for a in rows for b in rows if near(a, b)]
    assert all(x in true for x in tree)
    assert len(forest(len(rows), tree)) == len(tree) == len(forest(len(rows), true)) == len(forest(len(rows), tree + true))


def test_many_short_near_copies_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from resona.llm.ngram_join import _verified, digest, shingle_sets

    n = 9_000
    start = " ".join(f"w{k}" for k in range(29))
    texts = [f"{start} last{k}" for k in range(n)]
    sets = shingle_sets(pa.array(texts))
    nodes = [digest(s) for s in sets]
    table = pa.record_batch({"cluster": ["c"] * n, "node": pa.array(nodes, pa.binary()), "copies": [1] * n, "i": [0] * n, "j": [0] * n, "side": [0] * n, "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    tracemalloc.start()
    out = [r for b in _verified(iter([table]), 0.8) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    assert {r["a"]: r["links"] for r in out if r["b"] is None} == dict.fromkeys(nodes, n - 1)
    at = {x: k for k, x in enumerate(nodes)}
    assert len(forest(n, [(at[r["a"]], at[r["b"]]) for r in out if r["b"] is not None])) == n - 1


def test_one_of_each(make_docs, corpus):
    docs = make_docs(corpus)
    got = one_of_each(docs)
    assert got.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    _, name = groups(corpus)
    blank = {(i, t or "") for i, t in corpus if not (t or "").split()}
    left = {(i, t or "") for i, t in rows}
    assert len(rows) == len(left)
    assert blank <= left
    classes = defaultdict(list)
    for (i, t), n in zip(corpus, name, strict=True):
        if (t or "").split():
            classes[n].append((i, t))
    for members in classes.values():
        stay = [m for m in set(members) if m in left]
        assert len(stay) == 1
        ids = [i for i, _ in members if i is not None]
        assert not ids or stay[0][0] == min(ids)


def test_measured_recall():
    assert found_at(1.0, DEPTH) == 1 and found_at(0.8, DEPTH) == pytest.approx(1 - (1 - 0.8**8) ** 16)
    assert 0 < found_at(0.8, 4) - found_at(0.8, 4, agreement(0.8)) < 1e-4
    n = TREES * DEPTH
    assert measured_recall({}, DEPTH, 0.8) == 1
    assert measured_recall({n: 50}, DEPTH, 0.8) == 1
    mixed = {n: 1000, int(0.82 * n): 3}  # a band of few pairs counts as much
    assert measured_recall(mixed, DEPTH, 0.8) < 0.98 < 0.9995 < measured_recall(mixed, 4, 0.8)


def test_prefixes_are_shortened_as_the_data_ask(spark, make_docs):
    from resona.llm import ngram_join as nj

    def depth(changed):
        rng = random.Random(2)
        rows = []
        for k in range(30):
            own = [f"w{rng.randrange(10_000)}" for _ in range(200)]
            rows.append((2 * k, " ".join(own)))
            for _ in range(changed):
                own[rng.randrange(200)] = "other"
            rows.append((2 * k + 1, " ".join(own)))
        signed = scratch.keep(make_docs(rows).select("doc_id", "text", nj.content().alias("content")).mapInArrow(lambda b: nj._signed(b, 5), nj.SIGNED), "signed")
        return nj.shortened(signed, scratch.keep(nj.planted(signed), "tries"), 0.8, 0.9995)

    assert depth(0) == DEPTH and depth(4) < DEPTH


def test_recall_by_band(make_docs):
    """Pairs of a known similarity: at least 0.9 of those near the threshold are found, and nearly all others; none under it."""
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(400):
        own = [f"w{rng.randrange(50_000)}" for _ in range(204)]
        other = list(own)
        for at in rng.sample(range(5, 199), 1 + k % 5):
            other[at] = f"x{rng.randrange(50_000)}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[2 * k] = len(a & b) / len(a | b)
    got = {r.doc_id: r.n_links for r in ngram_join(make_docs(rows)).collect()}
    for lo, hi, least in ((0.8, 0.85, 0.9), (0.85, 0.9, 0.98), (0.9, 1.0, 0.99)):
        band = [i for i, t in want.items() if lo <= t < hi]
        assert len(band) > 20 and sum(got[i] == 1 for i in band) >= least * len(band)
    assert not any(got[i] for i, t in want.items() if t < 0.8)


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"{k:03d}", f"{k + 1:03d}") for k in range(60)] + [("500", "7xx"), ("500", "500")] + [("900", f"9{rng.randrange(99):02d}") for _ in range(40)]
    frame = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.root for r in components(frame, "t").collect()}
    assert all(got[f"{k:03d}"] == "000" for k in range(61))
    assert got["7xx"] == "500" and {got[b] for a, b in edges if a == "900"} == {"900"}
    assert len(forest(4, [(0, 1), (1, 2), (0, 2), (2, 3)])) == 3


def test_overlaps():
    rng = np.random.default_rng(0)
    a, b = ([np.unique(rng.integers(0, 40, 20)).astype(np.uint64) for _ in range(n)] for n in (5, 7))
    assert overlaps(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_hashing():
    import pyarrow as pa

    texts = ["a b  a", None, "", "b a", "zz" * 60 + " a", "é a"]
    data, offsets = hashing.column_bytes(pa.array(texts))
    starts, ends, bounds = hashing.word_spans(data, offsets)
    h = hashing.word_hashes(data, starts, ends)
    names = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert names == [w for t in texts for w in (t or "").encode().split()]
    assert bounds.tolist() == [0, 3, 3, 3, 5, 7, 9]
    assert len(set(h.tolist())) == len(set(names))
    w = hashing.window_hashes(h, 2)
    assert w[1] != w[0] and w[1] == hashing.window_hashes(h[[3, 0]], 2)[0]
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    assert (expand(squeeze(values), 500) == values).all()
    assert minimisers(np.array([5, 1, 1, 7, 0], np.uint64), 2).tolist() == [1, 2, 4]
