"""The complexity model's features and figures by hand, and a model that survives being written."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from resona.operators import complexity as cx


def test_ngrams(spark):
    df = spark.createDataFrame([("fan x belt  hum",), ("",), (None,), ("a",)], "text string")
    words, chars = (cls(inputCol="text", outputCol="o").transform(df).select("o").collect() for cls in (cx.WordNGrams, cx.CharNGrams))
    assert [r.o for r in words] == [["fan", "belt", "hum", "fan belt", "belt hum", "fan belt hum"], [], [], []]
    want = [w[i : i + k] for w in (" fan ", " x ", " belt ", " hum ") for k in range(2, min(5, len(w)) + 1) for i in range(len(w) - k + 1)]
    assert [r.o for r in chars] == [want, [], [], [" a", "a ", " a "]]


def test_weights(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.sparse(5, [1, 3], [1.0, 4.0]), Vectors.sparse(5, [3], [4 * 0.5])), (Vectors.sparse(5, [], []), Vectors.sparse(5, [], []))], ["n", "idf"])
    a, b = (r.w for r in cx.Weighed(inputCols=["n", "idf"], outputCol="w").transform(df).collect())
    v = [1.0, (1 + math.log(4)) * 1.5]
    assert list(a.values) == pytest.approx([x / math.hypot(*v) for x in v]) and not len(b.values)


def queries(rng, n):
    easy, hard = ["what is", "show"], ["compare versus", "difference between"]
    nouns = ["bearing", "shaft", "gear", "rotor", "belt", "pump"]
    return [(i, int(h), f"{rng.choice(hard if h else easy)} {rng.choice(nouns)} and {rng.choice(nouns)}") for i in range(n) for h in [rng.random() < 0.4]]


def test_saved_model_and_threshold(spark, tmp_path):
    rows = queries(random.Random(1), 120)
    labelled = spark.createDataFrame(rows, "id long, label int, text string")
    model = cx.fit(labelled, ["bearing"])
    asked = spark.createDataFrame([(1, "difference between gear and pump", "en"), (2, "show belt and belt", "en"), (3, None, "en")], "id long, text string, lang string")
    got = cx.predict(model, asked)
    assert got.columns == ["id", "text", "lang", "is_complex", "confidence"]
    want = {r.id: (r.is_complex, round(r.confidence, 9)) for r in got.collect()}
    assert want[1][0] and not want[2][0] and all(c >= 0.45 for _, c in want.values())
    model.write().save(f"file://{tmp_path}/model")
    again = cx.predict(PipelineModel.load(f"file://{tmp_path}/model"), asked)
    assert {r.id: (r.is_complex, round(r.confidence, 9)) for r in again.collect()} == want
    strict = cx.predict(model, asked, 1.0).collect()
    assert not any(r.is_complex for r in strict)


def test_summary_by_hand(spark):
    rows = [(0, 1, 1, 0.9), (0, 2, 0, 0.5), (0, 3, 1, 0.5), (0, 4, 0, 0.1), (1, 5, 1, 0.2), (1, 6, 0, 0.3), (1, 7, 0, 0.4)]
    got = {r.metric: (r["mean"], r.spread) for r in cx.summary(spark.createDataFrame(rows, "fold int, id int, label int, p double")).collect()}
    assert got["accuracy"] == pytest.approx(((0.75 + 2 / 3) / 2, (0.75 - 2 / 3) / 2))
    assert got["precision"] == pytest.approx(((2 / 3 + 0) / 2, 1 / 3)) and got["recall"] == pytest.approx((0.5, 0.5)) and got["f1"] == pytest.approx((0.4, 0.4))
    assert got["roc_auc"] == pytest.approx(((3.5 / 4 + 0) / 2, 3.5 / 8))


def test_training_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"query": "Fark nedir", "label": "complex"}\n\n{"query": "ne"}\n{"label": "complex"}\n{no\n', "utf-8")
    (tmp_path / "terms.json").write_text('{"terms": ["rulman", "mil"]}', "utf-8")
    rows = cx.training(spark, str(tmp_path / "t.jsonl")).collect()
    assert sorted((r.text or "", r.label, r.problem) for r in rows) == [("", None, "no query"), ("", None, "not JSON"), ("Fark nedir", 1, None), ("ne", 0, None)]
    assert cx.domain_words(spark, str(tmp_path / "terms.json")) == ["rulman", "mil"]
    kinds = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(31)], "id long, label int")
    counts = cx.folds(kinds, 5).groupBy("label", "fold").agg(F.count("*").alias("n")).collect()
    assert all(max(r.n for r in counts if r.label == k) - min(r.n for r in counts if r.label == k) <= 1 for k in (0, 1))
