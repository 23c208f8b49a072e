"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a document's passage by m // error_every edits. It is split
into one piece more than that, so at least one piece occurs unchanged; an Aho-Corasick automaton finds
all pieces in one pass over a document, and Myers' bit-parallel distance checks the passage around a hit.
Case and runs of white space don't count. An item too short for an edit must occur as whole words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH = "doc_id long, item_id long, distance int"
#: Characters of test items that one pass over the documents takes; more items are taken in more passes.
BLOCK_CHARS = 2 << 20


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces that make up the item, with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> int:
    """Least edit distance of the pattern to any part of text, or some number over `most` if it is more.

    Stops at 0, and where the text left is too short to bring the distance down to `most`, or under the best so far.
    """
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best = mask, 0, m, m
    for left, c in zip(range(len(text), 0, -1), text, strict=True):
        if score - left > min(most, best - 1):
            break
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & mask, up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        up, down = (mh | ~(xv | ph)) & mask, ph & xv
    return best


def as_words(item: str, text: str, lo: int, hi: int) -> bool:
    """Whether the item stands in text[lo:hi] and neither of its ends lies inside a word."""
    at = text.find(item, lo, hi)
    while at >= 0:
        end = at + len(item)
        if not (at and item[0].isalnum() and text[at - 1].isalnum()) and not (end < len(text) and item[-1].isalnum() and text[end].isalnum()):
            return True
        at = text.find(item, at + 1, hi)
    return False


class Finder:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_every: int) -> None:
        import ahocorasick

        self.items = [(i, t, len(t) // error_every) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, errors) in enumerate(self.items):
            for at, piece in pieces(t, errors):
                places.setdefault(piece, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, where in places.items():
            self.machine.add_word(piece, (len(piece), where))
        if places:
            self.machine.make_automaton()

    def matches(self, text: str | None) -> dict[int, int]:
        """item_id -> least distance, of the items that occur in text."""
        found: dict[int, list[list[int]]] = {}
        text = plain(text)
        if not self.items or not text:
            return {}
        for last, (size, where) in self.machine.iter(text):
            for k, at in where:
                _, item, errors = self.items[k]
                begin = last - size + 1 - at
                lo, hi = max(0, begin - errors), begin + len(item) + errors
                spans = found.setdefault(k, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][:] = min(lo, spans[-1][0]), max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        out: dict[int, int] = {}
        for k, spans in found.items():
            item_id, item, errors = self.items[k]
            best = errors + 1
            for lo, hi in spans:
                part = text[lo:hi]
                if not errors:
                    best = min(best, 0 if as_words(item, text, lo, hi) else best)
                    continue
                best = min(best, 0 if item in part else myers(item, part, errors))
                if not best:
                    break
            if best <= errors:
                out[item_id] = min(best, out.get(item_id, best))
        return out


def _blocks(benchmark: DataFrame, item: str):
    """The distinct items with text, in blocks of bounded size, each sent to all tasks."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(item).isNotNull() & F.col("text").isNotNull()).select(F.col(item).cast("long").alias("item"), "text").distinct()
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    for k in range(n):
        yield spark.sparkContext.broadcast(sorted((r[0], plain(r[1])) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()))


def contaminated(docs: DataFrame, benchmark: DataFrame, error_every: int = 20, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Pairs of a document and a test item that occurs in it: doc_id, item_id, distance (the least).

    Items with null id or text, or without visible text, match nothing; an id with several texts matches by
    any of them. Items of under `error_every` characters must occur unchanged as whole words. Null or empty document text
    matches nothing; long texts are searched whole. Rows of one document id give one pair; a null id is kept as such. Of
    equal passages the least distance counts. Extra columns are not read. Empty tables give no pairs.
    """

    def match(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
        finder = Finder(block.value, error_every)
        for batch in batches:
            rows = [(k, i, d) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, d in finder.matches(t).items()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance"])

    source = docs.select(F.col(key).cast("long"), "text")
    out = None
    for block in _blocks(benchmark, item):
        part = source.mapInArrow(lambda b, block=block: match(b, block), MATCH)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_every: int = 20, item: str = "item_id") -> DataFrame:
    """The rows of docs in whose text no test item occurs, with all their columns; nothing is shuffled.

    Nulls, empty texts and items: as in contaminated(); such rows are kept.
    """
    place = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
        finder = Finder(block.value, error_every)
        for batch in batches:
            yield batch.filter(pa.array([not finder.matches(t) for t in batch.column(place).to_pylist()], pa.bool_()))

    for block in _blocks(benchmark, item):
        docs = docs.mapInArrow(lambda b, block=block: clean(b, block), docs.schema)
    return docs
