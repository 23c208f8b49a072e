"""Language-model scores, vector codes and whitening against brute force."""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from resona.llm import lm_scoring as lm
from resona.llm import vector_codes as codes
from resona.llm import whitening

# op11


def split(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))] + [b"\n"]


def test_tokens_and_pairs():
    texts = ["The cat", None, "", " \t a  THE x\n", "É" + "y" * 300]
    n, per_text, words = lm.tokens(pa.array(texts))
    names = words.to_pylist()
    assert [names[i] for i in n] == [w for t in texts for w in split(t)]
    assert per_text.tolist() == [len(split(t)) for t in texts] and names[-1] == b"\n"
    want = []
    for t in texts:
        before = b"\n"
        for w in split(t):
            last = int.from_bytes((before if before == b"\n" else b" " + before)[-2:], "big")
            start = (w if w == b"\n" else w + b" ")[:2].ljust(2, b"\0")
            if len(before) == 1 and before != b"\n":
                last = before[0]
            want.append(last << 16 | int.from_bytes(start, "big"))
            before = w
    assert lm.pairs(n, per_text, words).tolist() == want


def test_a_bit_mixers_bytes_add_up_to_one():
    rng = np.random.default_rng(1)
    mixer = lm.Mixer.fresh("tail")
    table = rng.normal(0, 2, lm.size("tail")).astype(np.float32)
    mixer.weights += rng.normal(0, 0.3, mixer.weights.shape)
    mixer.followed += rng.integers(0, 50, mixer.followed.shape)
    model = lm.Model(lm.Squeezed(tail=table), {"tail": mixer}, {"tail": mixer.refined()}, lm.Squeezed(), np.zeros(lm.TRUST))
    model = pickle.loads(pickle.dumps(model))
    part = lm.Bytes(np.arange(256, dtype=np.uint8), np.full(256, 3), [np.full(256, c, np.uint64) for c in (7, 8, 9, 10, 11)], np.zeros(256), np.arange(256))
    assert np.exp2(-model.cost("tail", iter([part]), 256)).sum() == pytest.approx(1, abs=1e-6)


def test_a_step_follows_the_slope_of_the_likelihood():
    rng = np.random.default_rng(2)
    logits, bit, n, place = [rng.normal(0, 1, (5, 8)) for _ in range(5)], rng.integers(0, 2, (5, 8)), np.array([1, 2, 3, 1, 7]), np.array([2, 2, 3, 9, 2])
    mixer = lm.Mixer.fresh("tail")

    def likelihood(weights):
        x, _, _ = lm.Mixer(weights, mixer.followed, mixer.squares, mixer.met).mixed(logits, place)
        p = 1 / (1 + np.exp(-x))
        return (n[:, None] * np.log(np.where(bit == 1, p, 1 - p))).sum()

    start = mixer.weights.copy()
    mixer.learn(logits, place, bit, n)
    for g, k in [(i, j) for i, j in zip(*np.nonzero(mixer.weights != start), strict=True)][:40]:
        up, down = start.copy(), start.copy()
        up[g, k] += 1e-5
        down[g, k] -= 1e-5
        slope = (likelihood(up) - likelihood(down)) / 2e-5
        assert mixer.weights[g, k] - start[g, k] == pytest.approx(mixer.rate * slope / math.sqrt(slope**2 + 1e-6), abs=1e-4)


def test_bit_counts_are_those_of_the_contexts(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode(): rng.randint(1, 9) for _ in range(200)}
    rows = spark.createDataFrame([(0, w, n) for w, n in words.items()] + [(0, b"\n", 5), (0, b"unknown", 0)], "kind int, name binary, n long").repartition(3)
    table = lm.tables(rows)["tail"]
    want = Counter()
    for w, n in words.items():
        for j in range(2, len(w) + 1):
            for bit in range(8):
                want[(w + b" ")[j] >> (7 - bit) & 1] += n
    first = 1 << lm.SLOTS["tail"][0]
    assert [table[b, :first].sum() for b in (0, 1)] == [want[0], want[1]]
    assert table[:, first:].sum() == 4 * sum(want.values())


def test_votes_for_the_word_that_follows():
    own = lm.Followers()
    own.learn(np.array([3, 3, 3, 4, 4]), np.array([9, 9, 8, 1, 2]))
    assert (own.word[3], own.votes[3], own.votes[4]) == (9, 1, 0)
    own.learn(np.array([3] * 3), np.array([8] * 3))
    assert (own.word[3], own.votes[3]) == (8, 2)
    assert own.trusted(own.votes[[3, 4]]).tolist() == [2, 0]


def test_scores(spark, make_docs, corpus):
    rng = random.Random(8)
    names = ["".join(rng.choice(["ka", "to", "mi", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    more = [(1000 + i, " ".join(rng.choice(names) for _ in range(60))) for i in range(150)]
    rows = corpus + more + [(5000, more[0][1])]
    docs = make_docs(rows).repartition(5)
    out = lm.lm_scores(docs, F.col("doc_id") % 5 == 0, chunk=20_000)
    assert out.columns == ["doc_id", *lm.COLUMNS]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    held = {i: i is not None and i % 5 == 0 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        ws = split(t)
        want[i, held[i], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5), sum(len(w) + (w != b"\n") for w in ws)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.n_bytes) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes) for r in got)
    unseen = [r for r in got if r.held_out and (r.doc_id or 0) >= 1000 and r.doc_id not in (1000, 5000)]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)  # other texts of the same words
    assert next(r.score for r in got if r.doc_id == 51) == next(r.score for r in got if r.doc_id == 52)  # empty, blank


def test_scores_of_little(spark, make_docs):
    assert lm.lm_scores(make_docs([(1, "a")]).where("false"), F.lit(False)).collect() == []
    (r,) = lm.lm_scores(make_docs([(1, "some words")]), F.lit(True)).collect()  # nothing to learn from
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and -60 < r.score < 0


# op12


def brute_codes(rows, parts, entries, rounds):
    kept = [(k, [math.floor(1024 * c) for c in v], lab) for k, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    w = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x[p * w : p * w + w], e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, x, _ in kept:
                own.setdefault(near(x, p)[1], []).append(x[p * w : p * w + w])
            books[p] = [[sum(c) // len(c) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(books[p])]
    out = [(k, "".join(f"{near(x, p)[1]:02x}" for p in range(parts)), sum(near(x, p)[0] for p in range(parts)), lab) for k, x, lab in kept]
    total = Counter()
    for _, _, e, lab in out:
        total[lab] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((k, c, e, total[lab], digest) for k, c, e, lab in out)


def vectors(rng, n, d=8):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(d)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows += [(n + i, rows[2][1], 0) for i in range(30)]  # copies
    rows += [(900, None, 0), (901, [math.nan] * d, 0), (902, [math.inf] + [0.0] * (d - 1), 1), (903, [None] + [0.1] * (d - 1), 1), (None, [0.3] * d, None), (4, [0.25] * d, 1), (4, [-0.25] * d, 1)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, `key` string, salt int, code string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, lab, "x", 1, "y") for k, v, lab in rows], VECTORS)


@pytest.mark.parametrize(("n", "entries", "block"), [(120, 16, 50), (120, 256, 4096), (3, 256, 4096)])
def test_vector_codes(spark, monkeypatch, n, entries, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = vectors(random.Random(n), n)
    single = [(k, v and [None if c is None else float(np.float32(c)) for c in v], lab) for k, v, lab in rows]
    got = codes.vector_codes(frame(spark, rows).repartition(4), entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_codes(single, 4, entries, 4)


def test_vector_codes_of_odd_tables(spark):
    assert codes.vector_codes(frame(spark, [])).collect() == []
    assert codes.vector_codes(frame(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.vector_codes(frame(spark, [(1, [0.5] * 6, 1)]))
    with pytest.raises(ValueError, match="equal parts"):
        codes.vector_codes(frame(spark, [(1, [0.5] * 4, 1), (2, [0.5] * 8, 1)]))
    with pytest.raises(OverflowError):
        codes.distances([(np.array([-(1 << 40)]), np.zeros(1, int))], np.array([[1 << 40]]))


# op13


def test_whitening(spark):
    rows = vectors(random.Random(3), 200, 6)
    got = whitening.whitened(frame(spark, rows).repartition(5), top=4).collect()
    kept = [(k, v) for k, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 4 * n and {r.n for r in got} == {n}
    assert all(abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-10 for r in got)
    want = Counter((k, sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True))) for (k, _), r in zip(kept, x, strict=True))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want
    for j in range(4):
        z = y @ v[:, j] / math.sqrt(e[j])
        own = sorted((r.deviation, r.whitened) for r in got if r.component == j + 1)
        sign = min((1, -1), key=lambda s: max(abs(a[1] - b[1]) for a, b in zip(own, sorted((d, s * w) for d, w in zip([sum((n * c - t) ** 2 for c, t in zip(r, sums, strict=True)) for r in x], z, strict=True)), strict=True)))
        assert [w for _, w in own] == pytest.approx([b for _, b in sorted((d, sign * w) for d, w in zip([sum((n * c - t) ** 2 for c, t in zip(r, sums, strict=True)) for r in x], z, strict=True))], abs=1e-9)


def test_passes_orthogonalise_what_one_cannot():
    rng = np.random.default_rng(6)
    y = rng.normal(size=(400, 6)) @ np.diag(10.0 ** -np.arange(0, 12, 2)) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    factors, off = [], []
    for number in range(4):
        q = whitening.solved(y, factors)
        off.append(np.abs(q.T @ q - np.eye(6)).max())
        factors.append(whitening.factor(q.T @ q, 400, number == 0))
    assert off[1] > 1e-3 and off[3] < 1e-12
    e, v = whitening.components(whitening.solved(y, factors).T @ whitening.solved(y, factors), factors, 400)
    s = np.linalg.svd(y)[1]
    assert e == pytest.approx(s**2 / 400, rel=1e-5)
    assert v.T @ v == pytest.approx(np.eye(6), abs=1e-12)


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, [0.5, 0.25], 1)])).collect() == []
    assert whitening.whitened(frame(spark, [(i, [0.5, 0.25], 1) for i in range(9)])).collect() == []
    rng = random.Random(9)
    flat = [(i, [rng.uniform(-1, 1), 0.5, c := rng.uniform(-1, 1), c], 1) for i in range(50)]  # two dimensions of four vary freely
    got = whitening.whitened(frame(spark, flat)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-8
    assert sum(r.explained for r in got if r.vec_id == 0) == pytest.approx(1)
    with pytest.raises(Exception, match="lengths|entries"):
        whitening.whitened(frame(spark, [(1, [0.5] * 4, 1), (2, [0.5] * 8, 1)])).collect()
