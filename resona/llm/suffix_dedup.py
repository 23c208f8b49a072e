"""Suffix-array dedup with sparse suffix arrays at content-selected minimiser positions.

Any passage of LENGTH words holds a minimiser (the word position with the least hash of its next GRAM words
among REACH neighbours) among its first REACH positions, chosen from the passage alone; from there the passage
goes on for at least CORE = LENGTH - REACH + 1 words. So it is enough to sort the suffixes that begin at
minimisers by their first CORE words: suffixes of which no other shares them are dropped. Those that have equal
neighbours are extended: each by a words to the left and REACH - 1 - a beyond the core, for every a, and again
compared with their neighbours. Equal extensions are repeats of LENGTH words, and all such are found.

The sorted suffixes are dealt out by range, so a core that a third of all documents share is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import packing, scratch

GRAM, REACH = 8, 17
#: Suffixes with one core beyond which their extensions are compared by a Spark aggregation.
HOT = 100_000
U = np.uint64
MASK = "chunk long, at int, repeated int, later int"
RESULT = "doc_id long, n_words long, n_repeated long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def minimisers(grams: np.ndarray, reach: int) -> np.ndarray:
    """Positions that hold the least value of some `reach` neighbours, the leftmost of equals."""
    if len(grams) < reach:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, reach)
    return np.unique(np.concatenate([view[lo : lo + 65_536].argmin(1) + np.arange(lo, min(lo + 65_536, len(view))) for lo in range(0, len(view), 65_536)]))


class Text:
    """Word hashes of a chunk, and its suffixes at minimisers."""

    def __init__(self, payload: bytes, length: int) -> None:
        from resona.llm.hashing import column_bytes, window_hashes, word_hashes, word_spans

        self.table = packing.unpack(payload)
        data, offsets = column_bytes(self.table.column("text"))
        starts, ends, self.bounds = word_spans(data, offsets)
        self.words = word_hashes(data, starts, ends, 1)
        self.length, self.core = length, length - REACH + 1
        self._windows = window_hashes
        self.windows: np.ndarray | None = None

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions with CORE words to go in their document, and the hashes of those words."""
        grams = self._windows(self.words, GRAM, 11)
        found = []
        for a, b in zip(self.bounds, self.bounds[1:], strict=False):
            if b - a >= self.length:
                at = a + minimisers(grams[a : b - GRAM + 1], REACH)
                found.append(at[at + self.core <= b])
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        return at, self._windows(self.words, self.core, 12)[at] if len(at) else np.zeros(0, U)

    def extensions(self, at: np.ndarray) -> np.ndarray:
        """A row per suffix: hashes of the LENGTH words from 0, 1, .. REACH - 1 before it (0: not in its document)."""
        if self.windows is None:
            self.windows = self._windows(self.words, self.length, 13)
        doc = np.searchsorted(self.bounds, at, side="right") - 1
        begin = at[:, None] - np.arange(REACH)[None, :]
        inside = (begin >= self.bounds[doc][:, None]) & (begin + self.length <= self.bounds[doc + 1][:, None])
        out = np.zeros(begin.shape, U)
        out[inside] = self.windows[begin[inside]] | U(1)
        return out


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, core = Text(payload, length).suffixes()
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(np.full(len(at), chunk, np.int64)), pa.array(at.astype(np.int32))], ["core", "chunk", "at"])


def _with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition, the suffixes next to one with an equal core, and those at its ends."""
    last: pa.RecordBatch | None = None  # the last row, held back until its next neighbour is seen
    sure = True  # whether that row stays in any case
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        core = batch.column(0).to_numpy(zero_copy_only=False)
        same = core[1:] == core[:-1]
        keep = np.zeros(len(core), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= sure
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        last, sure = batch.slice(batch.num_rows - 1), bool(keep[-1])
    if last is not None:
        yield last


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, dict[str, np.ndarray]]]:
    """chunk, payload and the fields of the list in the third column, one row at a time; rows of an empty list are left out."""
    for batch in batches:
        for i in range(batch.num_rows):
            found = batch.column(2)[i].values
            if found is not None and len(found):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), {f.name: found.field(f.name).to_numpy() for f in found.type}


def _extended(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for chunk, payload, found in _each(batches):
        text = Text(payload, length)
        for lo in range(0, len(found["at"]), 10_000):
            at, core = (found[k][lo : lo + 10_000] for k in ("at", "core"))
            hashes = text.extensions(at.astype(np.int64)).ravel().view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * REACH), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(np.full(len(at), chunk, np.int64)), pa.array(at), lists], ["core", "chunk", "at", "extensions"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For suffixes sorted by core, chunk and place: which extensions another has, and which an earlier one has (bit a)."""

    def masks(table: pa.Table) -> pa.RecordBatch:
        core, chunk, at = (table.column(i).to_numpy() for i in range(3))
        hashes = np.concatenate([c.flatten().to_numpy() for c in table.column(3).chunks]).reshape(-1, REACH)
        repeated, later = np.zeros(len(core), np.int32), np.zeros(len(core), np.int32)
        for a in range(REACH):
            order = np.argsort(hashes[:, a], kind="stable")  # equal ones stay in order of core, chunk and place
            h, c = hashes[order, a], core[order]
            same = (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & (h[1:] != 0)
            later[order[1:][same]] |= 1 << a
            repeated[order[1:][same]] |= 1 << a
            repeated[order[:-1][same]] |= 1 << a
        some = np.flatnonzero(repeated)
        return pa.RecordBatch.from_arrays([pa.array(chunk[some]), pa.array(at[some]), pa.array(repeated[some]), pa.array(later[some])], ["chunk", "at", "repeated", "later"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if rows >= HOT and batch.num_rows:
            core = batch.column(0).to_numpy()
            other = np.flatnonzero(core != held[-1].column(0)[-1].as_py())
            if len(other):
                held.append(batch.slice(0, int(other[0])))
                yield masks(pa.Table.from_batches(held))
                held, rows, batch = [], 0, batch.slice(int(other[0]))
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield masks(pa.Table.from_batches(held))


def _compared_hot(rows: DataFrame) -> DataFrame:
    """The same for cores too common for one task: extensions are counted by Spark, each on its own."""
    each = rows.select("core", "chunk", "at", F.posexplode("extensions").alias("a", "hash")).where("hash <> 0")
    counted = each.groupBy("core", "hash", "a").agg(F.count("*").alias("n"), F.min(F.struct("chunk", "at")).alias("first")).where("n > 1")
    hit = each.join(scratch.keep(counted, "hot"), ["core", "hash", "a"])
    later = F.struct("chunk", "at") != F.col("first")
    return hit.groupBy("chunk", "at").agg(F.bit_or(F.expr("shiftleft(1, a)")).alias("repeated"), F.bit_or(F.when(later, F.expr("shiftleft(1, a)")).otherwise(0)).alias("later"))


def _spans(mask: np.ndarray) -> list[dict]:
    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)]


def _results(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for _, payload, masks in _each(batches):
        text = Text(payload, length)
        n = int(text.bounds[-1])
        at = masks["at"].astype(np.int64)
        covers = []
        for name in ("repeated", "later"):
            bits = masks[name]
            starts = np.unique(np.concatenate([at[(bits >> a) & 1 == 1] - a for a in range(REACH)]))
            cover = np.zeros(n + 1, np.int64)
            cover[starts] += 1
            cover[starts + length] -= 1
            covers.append(np.cumsum(cover)[:n] > 0)
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_repeated", "n_removed", "spans", "kept")}
        keys, texts = text.table.column("key").to_pylist(), text.table.column("text").cast(pa.large_binary())
        touched = np.unique(np.searchsorted(text.bounds, np.flatnonzero(covers[0]), side="right") - 1)
        for i in touched:
            a, b = text.bounds[i], text.bounds[i + 1]
            own, gone = texts[int(i)].as_py().split(), covers[1][a:b]
            for k, v in zip(out, (keys[i], b - a, covers[0][a:b].sum(), gone.sum(), _spans(covers[0][a:b]), b" ".join(own[j] for j in np.flatnonzero(~gone)).decode()), strict=True):
                out[k].append(v if isinstance(v, (list, str)) or v is None else int(v))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))


def suffix_dedup(docs: DataFrame, length: int = 50, key: str = "doc_id", chunk_bytes: int = 4 << 20) -> DataFrame:
    """Documents that hold a passage of at least `length` words (25 or more) that occurs elsewhere too.

    Result: doc_id, n_words, n_repeated (words in such passages), n_removed (words in passages that also
    start earlier in the corpus), spans (maximal repeated runs of words, end exclusive) and kept (the words
    not removed, joined by one space). Words are runs of other bytes than ASCII white space. Earlier: smaller
    key (nulls first), then text, then place.

    Documents without such a passage, and null or shorter texts, give no row. Rows of one key are documents of
    their own; of equal rows the first is kept. Extra columns are not read. An empty table gives an empty result.
    """
    table, buckets = packing.chunked(docs, key, chunk_bytes)
    texts = table.select("chunk", "payload")
    suffixes = texts.mapInArrow(lambda b: _suffixes(b, length), "core long, chunk long, at int")
    ordered = suffixes.repartitionByRange("core", "chunk", "at").sortWithinPartitions("core", "chunk", "at")
    found = scratch.keep(ordered.mapInArrow(_with_neighbours, "core long, chunk long, at int"), "suffixes")
    common = scratch.keep(found.groupBy("core").agg(F.count("*").alias("n")).where(f"n > {HOT}"), "common")

    places = found.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("core", "at")).alias("found"))
    extended = texts.join(places, "chunk").mapInArrow(lambda b: _extended(b, length), "core long, chunk long, at int, extensions array<long>")
    if common.isEmpty():
        usual, hot = extended, None
    else:
        extended = scratch.keep(extended, "extended")
        usual, hot = extended.join(common, "core", "left_anti"), extended.join(common.select("core"), "core")
    masks = usual.repartition("core").sortWithinPartitions("core", "chunk", "at").mapInArrow(_compared, MASK)
    if hot is not None:
        masks = masks.unionByName(_compared_hot(hot))
    masks = scratch.keep(masks, "masks").repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("at", "repeated", "later")).alias("masks"))
    return texts.join(masks, "chunk").mapInArrow(lambda b: _results(b, length), RESULT)
