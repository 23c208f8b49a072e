"""N-grams counted as 64-bit hashes, and feature vectors made of them, for many texts at a time.

They are the n-grams, counts and weights of the stages of `complexity`, without their strings: different n-grams of one vocabulary
have the same hash with a probability of about 1e-5 where there are ten million of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from resona.functions.hashing import mix

#: Texts that are taken at a time, and distinct n-grams of texts that are held until they are added up.
TEXTS, HELD = 256, 1 << 20
KINDS = ("words", "chars")
U = np.uint64


def runs(items: np.ndarray, group: np.ndarray, sizes: range) -> tuple[np.ndarray, np.ndarray]:
    """For each size and place the hash of the run of so many items that begins there, and whether the run is inside its group."""
    factors = np.random.default_rng(11).integers(1 << 40, 1 << 62, (sizes[-1] + 1, sizes[-1])).astype(U) | U(1)
    hashes, inside = np.zeros((len(sizes), len(items)), U), np.zeros((len(sizes), len(items)), bool)
    for row, size in enumerate(sizes):
        n = max(0, len(items) - size + 1)
        total = np.full(n, size, U)
        for j in range(size):
            total += items[j : j + n] * factors[size, j]
        hashes[row, :n], inside[row, :n] = mix(total), group[:n] == group[size - 1 :][:n]
    return hashes, inside


def distinct(hashes: np.ndarray, inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the distinct runs of each text, the places from bounds[i] to bounds[i + 1], by text and hash."""
    texts, terms, counts = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        own = np.sort(hashes[:, a:b][inside[:, a:b]])
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
        texts.append(np.full(len(first), i))
        terms.append(own[first])
        counts.append(np.diff(np.append(first, len(own))))
    return np.concatenate(texts), np.concatenate(terms), np.concatenate(counts)


def counted(words: pa.Array, spaced: pa.Array) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct runs of one to three words (hashes) of each text, and of two to five characters inside words, of which each has a space on both sides."""
    bounds = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
    out = {"words": distinct(*runs(words.flatten().to_numpy().view(U), np.repeat(np.arange(len(words)), np.diff(bounds)), range(1, 4)), bounds)}
    texts = spaced.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = points == 32
    begins = space.copy()
    begins[1:] &= space[:-1]
    out["chars"] = distinct(*runs(mix(points.astype(U) + U(1 << 32)), np.cumsum(begins), range(2, 6)), np.cumsum([0, *map(len, texts)]))
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            yield batch.slice(lo, TEXTS)


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, term, fold, df, tf of some texts (fold, words, spaced) at a time: the texts with the n-gram, and its occurrences."""
    held: list[tuple] = []
    weight = 0

    def added() -> Iterator[pa.RecordBatch]:
        for kind in range(len(KINDS)):
            folds, terms, counts = (np.concatenate([h[i] for h in held if h[0] == kind]) for i in (1, 2, 3))
            for fold in np.unique(folds):
                own, at, df = np.unique(terms[folds == fold], return_inverse=True, return_counts=True)
                tf = np.bincount(at, counts[folds == fold], len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), fold, np.int32)), pa.array(df), pa.array(tf)], ["kind", "term", "fold", "df", "tf"])

    for batch in slices(batches):
        fold = batch.column(0).to_numpy()
        for kind, (texts, terms, counts) in enumerate(counted(batch.column(1), batch.column(2)).values()):
            held.append((kind, fold[texts], terms, counts))
            weight += len(terms)
        if weight >= HELD:
            yield from added()
            held, weight = [], 0
    if held:
        yield from added()


def vectors(batches: Iterator[pa.RecordBatch], names: list[np.ndarray], idf: list[np.ndarray], mean: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    """fold, id, label and features of texts (fold, words, spaced, id, label, lexical): (1 + ln count) * (idf + 1) of the n-grams that names
    (sorted hashes) has, each kind to length 1, and the lexical features less their mean, times scale."""
    size = sum(map(len, names)) + len(mean)
    for batch in slices(batches):
        n, begin = batch.num_rows, 0
        texts, indices, values = [], [], []
        for (text, terms, counts), own, weight in zip(counted(batch.column(1), batch.column(2)).values(), names, idf, strict=True):
            at = np.searchsorted(own, terms)
            known = at < len(own)
            known[known] = own[at[known]] == terms[known]
            text, at, counts = text[known], at[known], counts[known]
            value = (1 + np.log(counts)) * (weight[at] + 1)
            texts.append(text)
            indices.append(at + begin)
            values.append(value / np.sqrt(np.bincount(text, value * value, n))[text])
            begin += len(own)
        lexical = batch.column(5).flatten().to_numpy().reshape(n, -1)
        texts.append(np.repeat(np.arange(n), lexical.shape[1]))
        indices.append(np.tile(np.arange(begin, size), n))
        values.append(((lexical - mean) * scale).ravel())
        text = np.concatenate(texts)
        order = np.argsort(text.astype(np.uint16), kind="stable")
        offsets = np.searchsorted(text[order], np.arange(n + 1)).astype(np.int32)
        of = lambda parts, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts)[order].astype(kind)))  # noqa: B023, E731
        features = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), of(indices, np.int32), of(values, np.float64)], ["type", "size", "indices", "values"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), features], ["fold", "id", "label", "features"])
