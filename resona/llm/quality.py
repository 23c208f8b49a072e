"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector shared by all grades, ordered thresholds.
x says which hashed words and symbol runs a text holds (present or not), its length (as a power of two)
and, in twentieths, how many of its words repeat the word before, how many symbol runs it has per word and
how many of its bytes are capitals. Only features whose share
differs clearly between the top grade and some other grade have a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BITS = 20
SCORE = "expected_grade double, tail_probability double"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of a column of texts: (document index, feature), sorted."""
    from resona.llm.hashing import word_hashes, word_spans

    parts, sizes = [], {}
    for kind, seed in (("letters", 3), ("symbols", 4)):
        starts, ends, bounds = word_spans(data, offsets, kind)
        sizes[kind] = np.diff(bounds)
        doc = np.repeat(np.arange(len(offsets) - 1), sizes[kind])
        words = word_hashes(data, starts, ends, seed, fold=True)
        parts.append((doc.astype(np.int64) << BITS) | (words >> np.uint64(64 - BITS)).astype(np.int64))
        if kind == "letters":
            again = np.bincount(doc[1:], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]), minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1)
    capitals = np.diff(np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])[offsets])
    n = np.maximum(sizes["letters"], 1)
    levels = (np.frexp(sizes["letters"])[1], 64 + np.ceil(20 * again / n), 128 + np.minimum(np.ceil(20 * sizes["symbols"] / n), 60), 192 + np.ceil(20 * capitals / np.maximum(np.diff(offsets), 1)))
    parts += [(np.arange(len(n), dtype=np.int64) << BITS) | x.astype(np.int64) for x in levels]
    both = np.unique(np.concatenate(parts))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def informed(self) -> bool:
        """Whether any feature has a weight; if not, all texts are judged alike."""
        return bool(self.weights.any())

    def tails(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        eta = np.bincount(doc, self.weights[feature], minlength=n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -50, 50)))


def slopes(x: np.ndarray, doc: np.ndarray, column: np.ndarray, grade: np.ndarray, grades: int, decay: float) -> np.ndarray:
    """Gradient of the mean log-likelihood less decay / 2 times the squared weights; x: the weights, the first threshold and the logarithms of the steps to the others."""
    n, k = len(grade), len(x) - grades + 1
    cuts = np.cumsum(np.concatenate([x[k : k + 1], np.exp(x[k + 1 :])]))
    eta = np.bincount(doc, x[:k][column], minlength=n)
    below = 1 / (1 + np.exp(np.clip(eta[:, None] - np.concatenate([[-np.inf], cuts, [np.inf]])[None, :], -50, 50)))
    below[:, 0], below[:, -1] = 0, 1
    rows = np.arange(n)
    a, b = below[rows, grade + 1], below[rows, grade]
    p = np.maximum(a - b, 1e-12)
    cut_slope = np.zeros((n, grades + 1))
    cut_slope[rows, grade + 1] += a * (1 - a) / p
    cut_slope[rows, grade] -= b * (1 - b) / p
    by_cut = cut_slope[:, 1:-1].sum(0) / n
    return np.concatenate([np.bincount(column, (a + b - 1)[doc], minlength=k) / n - decay * x[:k], [by_cut.sum()], [by_cut[j:].sum() * np.exp(x[k + j]) for j in range(1, len(by_cut))]])


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int, z: float = 5.0, decay: float = 2e-4, steps: int = 400) -> Model:
    """Full-batch Adam on the ordinal likelihood; thresholds are a first one and positive steps. The last quarter's steps shrink.

    A feature has a weight if its share differs between the top grade and some other by more than z deviations. Where none
    does (under some hundred ratings), the model isn't informed.
    """
    n, top = len(grade), grades - 1
    total = np.bincount(grade, minlength=grades)
    chosen = np.zeros(1 << BITS, bool)
    if n and total[top]:
        has = [np.bincount(feature[grade[doc] == g], minlength=1 << BITS) for g in range(grades)]
        for g in range(top):
            if total[g]:
                p = (has[g] + has[top] + 0.5) / (total[g] + total[top] + 1)
                gap = has[g] / total[g] - has[top] / total[top]
                chosen |= np.abs(gap) / np.sqrt(p * (1 - p) * (1 / total[g] + 1 / total[top])) > z
    names = np.flatnonzero(chosen)
    keep = chosen[feature]
    doc, column = doc[keep], np.searchsorted(names, feature[keep])
    share = (np.cumsum(total)[:-1] + 0.5) / (n + 1)
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(len(names)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = len(names)
    for step in range(1, steps + 1 if n else 1):
        gradient = slopes(x, doc, column, grade, grades, decay)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        x += 0.05 * min(1.0, 4 * (1 - (step - 1) / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(1 << BITS)
    weights[names] = x[:k]
    return Model(weights, np.cumsum(np.concatenate([x[k : k + 1], np.exp(x[k + 1 :])])))


def train(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, sample: int = 8_000, key: str = "doc_id") -> Model:
    """Fit on at most `sample` rated documents, those whose id has the smallest hash.

    grade: an integer column of ratings, 0 to grades - 1. Ratings of null id or grade don't count; of
    several ratings of a document the lowest does. Documents are found by id; null text is empty; of several rows of one id
    one counts, that of the least features. Long texts are read whole. Without rated documents the model isn't informed.
    """
    from resona.llm.hashing import column_bytes, slices

    rated = ratings.select(F.col(key).cast("long").alias("rated"), grade.cast("int").alias("grade")).dropna().groupBy("rated").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("rated"), "rated").limit(sample)  # at most `sample` rows of 12 bytes

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                doc, feature = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), batch.column(2).slice(lo, hi - lo)], ["grade", "features", "rated"])

    found = docs.select(F.col(key).cast("long").alias("rated"), "text").join(F.broadcast(chosen), "rated").select("grade", "text", "rated").mapInArrow(numbers, "grade int, features binary, rated long")
    rows = found.groupBy("rated").agg(F.min("grade"), F.min("features")).select("min(grade)", "min(features)").collect()  # one row an id
    rows.sort(key=lambda r: (r[0], r[1]))
    found = [np.frombuffer(r[1], np.int32) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in found])
    return fit(doc, np.concatenate(found) if found else np.zeros(0, np.int32), np.array([r[0] for r in rows], np.int64), grades)


def score(docs: DataFrame, model: Model, tail: int) -> DataFrame:
    """docs with expected_grade and tail_probability = P(grade >= tail).

    Null and empty texts have no features and so get the thresholds' own probabilities. Rows are judged one
    by one, so ties and repeats score alike. Columns of these two names are replaced.
    """
    from resona.llm.hashing import column_bytes, slices

    docs = docs.drop("expected_grade", "tail_probability")
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(place))
            tails = [np.zeros((0, len(shared.value.thresholds)))]
            for lo, hi in slices(offsets):
                tails.append(shared.value.tails(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), hi - lo))
            all_tails = np.round(np.concatenate(tails), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(all_tails.sum(1), 6)), pa.array(all_tails[:, tail - 1])], [*batch.schema.names, "expected_grade", "tail_probability"])

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail_probability", DoubleType())]))
