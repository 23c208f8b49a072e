"""An inverted index of some documents in memory, with block maxima: the exact best of many queries at once.

Documents stand in blocks of like words and length. A term's postings in a block are an entry, which knows its largest impact:
the sum of these maxima bounds what a query can reach in a block. Each query is scored in the block of its highest bound first, and
then in those blocks alone whose bound reaches the k-th score it has by then, here or elsewhere. In a block, entries that a good part
of its documents share are rows of a matrix, whose product with all queries' weights is made at once; others are added posting by
posting.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from resona.functions.hashing import column_bytes, slices, word_hashes, word_spans

#: Documents of a block, 1 << 16 at most; the most terms of a block that are kept as rows over its documents, those of at least 1 / COMMON_SHARE of them.
BLOCK, COMMON, COMMON_SHARE = 8192, 1024, 14
#: Bytes and documents of a shard, and queries that are compared with it at a time.
SHARD_BYTES, SHARD_DOCS, QUERIES = 16 << 20, 20_000, 256
#: What two sums of the same numbers may differ by, with half of the last decimal of each.
SLACK = 2e-6


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text: (document, term, count), sorted by both, and each document's length.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; ASCII capitals count as small.
    """
    data, offsets = column_bytes(column)
    docs, terms, counts, lengths = [], [], [], []
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo], "letters")
        words = word_hashes(part, starts, ends, 3, fold=True)
        lengths.append(np.diff(bounds))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if b > a:
                own, n = np.unique(words[a:b], return_counts=True)
                docs.append(np.full(len(own), lo + i, np.int64))
                terms.append(own)
                counts.append(n)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(docs, np.int64), join(terms, np.uint64), join(counts, np.int64), join(lengths, np.int64)


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of some megabytes of text at a time; term null: df counts documents, words their words."""
    def row(terms, df, words=None):
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(df, pa.int64()), pa.array(words or [0] * len(df), pa.int64())], ["term", "df", "words"])

    held, weight, n, words = [], 0, 0, 0

    def merged() -> pa.RecordBatch:
        terms, df = np.unique(np.concatenate(held), return_counts=True)
        return row(terms.view(np.int64), df)

    for batch in batches:
        _, terms, _, lengths = term_counts(batch.column(0))
        held.append(terms)
        weight += len(terms)
        n, words = n + len(lengths), words + int(lengths.sum())
        if weight > 4 << 20:
            yield merged()
            held, weight = [], 0
    if weight:
        yield merged()
    yield row([None], [n], [words])


class Shard:
    """Inverted index of documents: ids and lengths by document; documents, terms and impacts by posting."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impact: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> None:
        self.terms, at, df = np.unique(terms, return_inverse=True, return_counts=True)
        order = np.lexsort((lengths, leading(docs, at, impact, np.argsort(-df, kind="stable")[:64], len(ids))))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        docs = place[docs]
        by = np.argsort(at * np.int64(len(ids) + 1) + docs)
        docs, at, impact = docs[by], at[by], impact[by]
        self.ids, self.size, self.blocks = ids[order], block, -(-len(ids) // block)
        within = docs // block
        new = np.ones(len(docs), bool)
        new[1:] = (at[1:] != at[:-1]) | (within[1:] != within[:-1])
        first = np.flatnonzero(new)
        self.term_at = np.searchsorted(at[first], np.arange(len(self.terms) + 1))
        self.docs, self.impact = (docs % block).astype(np.uint16), impact
        self.entry_at, self.entry_size = first, np.diff(np.append(first, len(docs)))
        self.entry_block = within[first].astype(np.uint16)
        self.entry_max = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0)
        self.entry_row = np.full(len(first), -1, np.int32)
        self.dense = [self._rows(b) for b in range(self.blocks)]

    def _rows(self, b: int) -> np.ndarray:
        """The common entries of a block as rows over its documents."""
        n = min(self.size, len(self.ids) - b * self.size)
        own = np.flatnonzero((self.entry_block == b) & (self.entry_size * COMMON_SHARE >= n))
        own = own[np.argsort(-self.entry_size[own], kind="stable")[:COMMON]]
        self.entry_row[own] = np.arange(len(own))
        rows = np.zeros((len(own), n))
        postings, size = spread(self.entry_at[own], self.entry_at[own] + self.entry_size[own])
        rows[np.repeat(np.arange(len(own)), size), self.docs[postings]] = self.impact[postings]
        return rows

    def search(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (its number), id and score of the best k of each query, by score (to six decimals) and then id.

        Query i has the distinct terms[at[i]:at[i + 1]] and their weights, which are positive. Scores under least[i] may be left out;
        where the shard has k for the query, least[i] rises to the last of them.
        """
        n = len(least)
        places, known = known_at(self.terms, terms)
        entries, size = spread(self.term_at[places], self.term_at[places + 1])
        query, weight = np.repeat(np.repeat(np.arange(n), np.diff(at))[known], size), np.repeat(weights[known], size)
        where = self.entry_block[entries]
        bound = np.bincount(query * self.blocks + where, weight * self.entry_max[entries], minlength=n * self.blocks).reshape(n, self.blocks)
        by = np.argsort(where, kind="stable")
        query, weight, entries = query[by], weight[by], entries[by]
        cuts = np.searchsorted(where[by], np.arange(self.blocks + 1))
        best = np.zeros(0, np.int64), np.zeros(0, self.ids.dtype), np.zeros(0)
        home = bound.argmax(1) if self.blocks else np.zeros(n, np.int64)
        for at_home in (True, False):
            for b in range(self.blocks):
                asked = np.flatnonzero(((home == b) == at_home) & (bound[:, b] > 0) & (bound[:, b] >= least - SLACK))
                if len(asked):
                    part = slice(cuts[b], cuts[b + 1])
                    found = self._scores(b, asked, n, query[part], weight[part], entries[part])
                    row, doc = likely(found, least[asked], k)
                    new = asked[row], self.ids[b * self.size + doc], np.round(found[row, doc], 6)
                    best = first_k(*(np.concatenate(x) for x in zip(best, new, strict=True)), k)
                    last = np.searchsorted(best[0], best[0]) + k - 1 == np.arange(len(best[0]))
                    least[best[0][last]] = np.maximum(least[best[0][last]], best[2][last])
        return best

    def _scores(self, b: int, asked: np.ndarray, n: int, query: np.ndarray, weight: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """The scores of the asked queries, of n, for all documents of a block."""
        place = np.full(n, -1)
        place[asked] = np.arange(len(asked))
        own, row = place[query], self.entry_row[entries]
        common, rest = (own >= 0) & (row >= 0), (own >= 0) & (row < 0)
        weights = np.zeros((len(asked), len(self.dense[b])))
        weights[own[common], row[common]] = weight[common]
        found = weights @ self.dense[b]
        own, weight, entries = own[rest], weight[rest], entries[rest]
        starts, sizes = self.entry_at[entries], self.entry_size[entries]
        ends = np.searchsorted(own, np.arange(len(asked) + 1))  # entries stand by query
        for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            if lo < hi:
                size = sizes[lo:hi]
                postings = np.repeat(starts[lo:hi] - np.cumsum(size) + size, size)
                postings += np.arange(len(postings))
                added = self.impact.take(postings)
                added *= np.repeat(weight[lo:hi], size)
                found[i] += np.bincount(self.docs.take(postings), added, minlength=found.shape[1])
        return found


def searched(parts: Iterable[tuple], files: list[str], mean: float, k: int, k1: float = 1.2, b: float = 0.75, block: int = BLOCK, shard_docs: int = SHARD_DOCS) -> Iterator[pa.RecordBatch]:
    """query_id, id, score of the best k of each shard of documents for each query by BM25; of a later shard, only those that may be among the best k of all.

    parts: ids of some documents, then document (its place in ids), term and count by posting, the documents' lengths and bytes. files:
    Parquet files of queries (query_id, terms, weights). mean: the mean length of all documents.
    """
    import pyarrow.parquet as pq
    from pyarrow import fs

    held: list[tuple] = []
    least: list[np.ndarray] = []  # of each batch of queries: the k-th scores so far
    weight, n = 0, 0

    def answers() -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0, *(len(h[0]) for h in held)])
        ids, terms, counts, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 4))
        docs = np.concatenate([h[1] + n for h, n in zip(held, before, strict=False)])
        held.clear()
        shard = Shard(ids, docs, terms, counts * (k1 + 1) / (counts + k1 * (1 - b + b * lengths[docs] / mean)), lengths, block)
        turn = 0
        for name in files:
            store, path = fs.FileSystem.from_uri(name)
            with store.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(QUERIES):
                    if turn == len(least):
                        least.append(np.zeros(batch.num_rows))
                    names, asked, weights = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
                    at = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy())])
                    query, ids, scores = shard.search(at, asked.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy(), least[turn], k)
                    turn += 1
                    yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

    for *part, size in parts:
        held.append(part)
        weight, n = weight + size, n + len(part[0])
        if weight >= SHARD_BYTES or n >= shard_docs:
            yield from answers()
            weight, n = 0, 0
    if held:
        yield from answers()


def likely(found: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns, by row, of the sums that may reach the row's least and be among its best k."""
    over = found > np.maximum(least - SLACK, 0.0)[:, None]
    many = np.flatnonzero(np.count_nonzero(over, axis=1) > k)
    if len(many):
        over[many] &= found[many] >= np.partition(found[many], -k, axis=1)[:, -k, None] - SLACK
    return np.divmod(np.flatnonzero(over), found.shape[1])


def first_k(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each query by score and id, by query."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], ids[best], scores[best]


def known_at(names: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted names of those terms that are there, and which they are."""
    at = np.searchsorted(names, terms)
    known = at < len(names)
    known[known] = names[at[known]] == terms[known]
    return at[known], known


def leading(docs: np.ndarray, terms: np.ndarray, most: np.ndarray, wide: np.ndarray, n: int) -> np.ndarray:
    """For each document the one of the `wide` terms that it has most of, so that texts of one language stand together and blocks of others have low bounds."""
    out = np.full(n, -1)
    some = np.flatnonzero(np.isin(terms, wide))
    some = some[np.lexsort((terms[some], most[some], docs[some]))]
    out[docs[some]] = terms[some]  # the last of each document stays
    return out


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and the ranges' sizes."""
    size = ends - starts
    return np.arange(int(size.sum())) + np.repeat(starts - np.cumsum(size) + size, size), size
