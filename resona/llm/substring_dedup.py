"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

The text is packed in document order into chunks of a few megabytes. Two rounds find out, for each
window of each chunk, whether another chunk holds the same words:

1. filter: every window's hash, cut to about log2(windows) + 12 bits. Each chunk sends each distinct
   value once, as sorted differences, to the reducer of its hash range; the reducer counts chunks and
   answers with one bit a value.
2. exact: only windows whose bit is set, now with 128 bits; the answer is whether an earlier chunk has it.

A value common to all documents is one entry per chunk, so no key is ever hot, and what is shuffled is
compressed differences and bits instead of a row per window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import packing, scratch

U = np.uint64
BLOCK = "part int, chunk long, n int, first binary, second binary"
REPLY = "chunk long, part int, n int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte plane by byte plane, compressed."""
    planes = np.diff(values, prepend=U(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * n), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(U).ravel())


class Windows:
    """All windows of one chunk: hashes, and the way back to documents."""

    def __init__(self, payload: bytes, width: int, exact: bool) -> None:
        from resona.llm.hashing import column_bytes, in_one_document, window_hashes, word_hashes, word_spans

        self.table = packing.unpack(payload)
        data, offsets = column_bytes(self.table.column("text"))
        starts, ends, self.bounds = word_spans(data, offsets)
        self.at, _ = in_one_document(self.bounds, width)
        hashes = [window_hashes(word_hashes(data, starts, ends, seed), width, seed + 6)[self.at] if len(self.at) else np.zeros(0, U) for seed in ((1, 2) if exact else (1,))]
        self.first, self.second = hashes[0], hashes[-1]


def cut(total: int) -> tuple[int, int]:
    """Bits of the filter round, and hash ranges of about a million windows each."""
    return min(64, max(40, math.ceil(math.log2(total + 1)) + 12)), max(1, math.ceil(total / (1 << 20)))


def edges(bits: int, parts: int) -> np.ndarray:
    return np.array([((i << bits) + parts - 1) // parts for i in range(1, parts)], U)


def answers(replies: list[dict], n: int, values: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The bits of one chunk's sorted values, put together from all ranges."""
    out = np.zeros(n, bool)
    at = np.concatenate([[0], np.searchsorted(values, edges(bits, parts)), [n]])
    for r in replies or ():
        out[at[r["part"]] : at[r["part"] + 1]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).view(bool)
    return out


def _blocks(chunk: int, first: np.ndarray, second: np.ndarray | None, bits: int, parts: int) -> pa.RecordBatch:
    at = np.concatenate([[0], np.searchsorted(first, edges(bits, parts)), [len(first)]])
    full = [k for k in range(parts) if at[k] < at[k + 1]]
    return pa.RecordBatch.from_pydict({
        "part": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "n": pa.array([at[k + 1] - at[k] for k in full], pa.int32()),
        "first": pa.array([squeeze(first[at[k] : at[k + 1]]) for k in full], pa.binary()),
        "second": pa.array([None if second is None else second[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()),
    })


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _filter_blocks(batches: Iterator[pa.RecordBatch], width: int, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        values = np.unique(Windows(row["payload"], width, False).first >> U(64 - bits))
        if len(values):
            yield _blocks(row["chunk"], values, None, bits, parts)


def _shared(w: Windows, replies: list[dict], bits: int, parts: int) -> np.ndarray:
    """Which windows may occur in another chunk, by the answers of the filter round."""
    values, back = np.unique(w.first >> U(64 - bits), return_inverse=True)
    return answers(replies, len(values), values, bits, parts)[back]


def _ordered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in stable order of the 128-bit values, and which of them begin a new value."""
    order = np.argsort(first, kind="stable")
    new = np.ones(len(order), bool)
    same = first[order][1:] == first[order][:-1]
    if (second[order][1:] != second[order][:-1])[same].any():
        order = np.lexsort((second, first))
        same = first[order][1:] == first[order][:-1]
    new[1:] = ~(same & (second[order][1:] == second[order][:-1]))
    return order, new


def _exact_blocks(batches: Iterator[pa.RecordBatch], width: int, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        if row["replies"]:
            w = Windows(row["payload"], width, True)
            shared = _shared(w, row["replies"], bits, parts)
            first, second = w.first[shared], w.second[shared]
            order, new = _ordered(first, second)
            order = order[new]
            if len(order):
                yield _blocks(row["chunk"], first[order], second[order], 64, parts)


def _reply(pdf, earlier: bool):
    """earlier: is it in a chunk of a smaller number? else: is it in another chunk?"""
    import pandas as pd

    pdf = pdf.sort_values("chunk", kind="stable")
    sizes = pdf["n"].to_numpy()
    first = np.concatenate([expand(x, n) for x, n in zip(pdf["first"], sizes, strict=True)])
    if earlier:
        second = np.concatenate([np.frombuffer(x, U) for x in pdf["second"]])
        order, new = _ordered(first, second)
        hit = ~new
    else:
        order = np.argsort(first, kind="stable")
        same = first[order][1:] == first[order][:-1]
        hit = np.zeros(len(order), bool)
        hit[1:] |= same
        hit[:-1] |= same
    out = np.empty(len(order), bool)
    out[order] = hit
    ends = np.cumsum(sizes)
    bits = [np.packbits(out[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
    keep = [k for k, (e, n) in enumerate(zip(ends, sizes, strict=True)) if out[e - n : e].any()]
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[keep], "part": pdf["part"].to_numpy()[keep], "n": sizes[keep], "bits": [bits[k] for k in keep]})


def _removed(row: dict, width: int, bits: int, parts: int) -> pa.RecordBatch:
    w = Windows(row["payload"], width, True)
    shared = _shared(w, row["replies"], bits, parts)
    order, new = _ordered(w.first, w.second)
    gone = np.zeros(len(order), bool)
    gone[order[~new]] = True
    if row["owned"] and shared.any():
        where = np.flatnonzero(shared)
        order, new = _ordered(w.first[where], w.second[where])
        earlier = answers(row["owned"], int(new.sum()), w.first[where][order[new]], 64, parts)
        gone[where[order]] |= earlier[np.cumsum(new) - 1]
    words = int(w.bounds[-1])
    cover = np.zeros(words + 1, np.int64)
    starts = w.at[gone]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    lost = np.cumsum(cover)[:words] > 0
    ids, counts, removed, spans, kept = w.table.column("key").to_pylist(), [], [], [], []
    for i, text in enumerate(w.table.column("text").cast(pa.large_binary()).to_pylist()):
        mask = lost[w.bounds[i] : w.bounds[i + 1]]
        own = (text or b"").split()
        counts.append(len(own))
        removed.append(int(mask.sum()))
        if removed[-1]:
            change = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)])
            own = [own[k] for k in np.flatnonzero(~mask)]
        else:
            spans.append([])
        kept.append(b" ".join(own).decode("utf-8"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def substring_dedup(docs: DataFrame, width: int = 20, key: str = "doc_id", chunk_bytes: int = 4 << 20) -> DataFrame:
    """Remove each word covered by a window of `width` words that also starts earlier in the corpus.

    Words are runs of other bytes than ASCII white space. Windows are judged on the input. Result: a row
    per input row with doc_id, n_words, n_removed, spans (maximal removed runs of words, end exclusive)
    and kept (the other words, joined by one space).

    Null text: no words. Documents of under `width` words: kept whole. Null keys come first in the order.
    Rows with one key are documents of their own, in order of their text; equal rows: the first is kept.
    Extra columns of the input are not read. An empty table gives an empty result.
    """
    table, buckets = packing.chunked(docs, key, chunk_bytes)
    total = table.agg(F.sum("n_words")).first()[0] or 0
    bits, parts = cut(total)

    def answered(blocks: DataFrame, earlier: bool, name: str) -> DataFrame:
        replies = blocks.groupBy("part").applyInPandas(lambda pdf: _reply(pdf, earlier), REPLY)
        return scratch.keep(replies, name).repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", "n", "bits")).alias("replies" if not earlier else "owned"))

    shared = answered(table.select("chunk", "payload").mapInArrow(lambda b: _filter_blocks(b, width, bits, parts), BLOCK), False, "shared")
    joined = table.select("chunk", "payload").join(shared, "chunk", "left")
    owned = answered(joined.mapInArrow(lambda b: _exact_blocks(b, width, bits, parts), BLOCK), True, "owned")
    return joined.join(owned, "chunk", "left").mapInArrow(lambda b: (_removed(r, width, bits, parts) for r in _rows(b)), RESULT)
