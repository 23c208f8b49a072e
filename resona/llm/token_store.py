"""Token ids as raw binary shards with a minimal perfect hash index from document keys to their place.

Layout of a store: shards/*.ids hold raw little-endian ids (16 bits wide where the vocabulary allows, else
32), written in ascending key order; manifest/ says how many ids come before each shard; index/*.mph are
hash buckets of keys. A bucket maps each of its keys to a slot of its own without storing the key; a slot
holds a fingerprint, shard, offset and length, so that a look-up reads a bucket's few kilobytes of bits and the page
of one slot, whatever the store's size.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from resona.llm import scratch
from resona.llm.hashing import mix

U = np.uint64
ENTRY = "shard long, addr long, no_key boolean, ordinal int, at long, n long"
#: UTF-8 of characters that two regular expression engines may class differently, as first bytes and what may follow each;
#: texts with one are encoded in one call, as are those with an added token.
ODD = {b"\x1c\x1d\x1e\x1f": [b""], b"\xc2": [b"\x85", b"\xa0"], b"\xe1": [b"\x9a\x80", b"\xa0\x8e"], b"\xe3": [b"\x80\x80"], b"\xef": [b"\xbb\xbf"], b"\xe2": [b"\x81\x9f", b"\x81\xa0", *(b"\x80" + bytes([k]) for k in [*range(0x80, 0x90), 0xA8, 0xA9, 0xAF])]}
#: Shards of a partition are numbered from its number shifted by so many bits.
PART_BITS = 24
#: Pieces in each of two generations; those used again move to the newer before the older is dropped.
REMEMBERED = 250_000
JOINED = 256
LEVELS = 40
#: Bits to an entry of a bucket's directory, and records to a page.
RANK, PAGE = 512, 64
RECORD = np.dtype([("mark", "<u4"), ("shard", "<i8"), ("at", "<i8"), ("n", "<i8")])


def _byte_marks() -> set[str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(i) for i in visible} | {chr(256 + k) for k in range(256 - len(visible))}


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte, whether it is ASCII white space, an ASCII letter, an ASCII symbol other than an apostrophe, or may begin one of ODD."""
    letter = np.array([i < 128 and chr(i).isalpha() for i in range(256)])
    symbol = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) != "'" for i in range(256)])
    return np.isin(np.arange(256), list(b" \t\n\v\f\r")), letter, symbol, np.isin(np.arange(256), list(b"".join(ODD)))


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level BPE with the usual splitting pattern never joins characters over a change from a visible one to
    white space, or from a letter to a symbol other than an apostrophe, so a text's ids are those of its pieces between
    such changes; each different piece is encoded once and remembered. Added tokens (such as <|endoftext|>) are found in
    a text before that, so texts with one are encoded in one call; so are all texts where the tokenizer's file says that
    it normalises or splits in another way.
    """

    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        stated = json.loads(self.library.to_str())
        cut = stated["pre_tokenizer"] or {}
        self.cuttable = stated["normalizer"] is None and stated["model"]["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # an added token with white space inside could arise where pieces of different texts meet
        self.joined = 1 if any(len(t.split()) != 1 for t in self.added) else JOINED
        self.kind = np.dtype("<u2" if max(self.library.get_vocab_size(), end + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end], self.kind).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.space, self.letter, self.symbol, self.odd = _classes()
        marks = _byte_marks()
        self.lengths = np.zeros(max(self.library.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.lengths[i] = len(token) if marks.issuperset(token) else len(token.encode())

    @classmethod
    def of(cls, path: str, end: int) -> Encoder:
        if (path, end) not in cls._made:
            cls._made[path, end] = cls(path, end)
        return cls._made[path, end]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces: those that begin with white space and end without are encoded as one text per JOINED of them.

        The tokens of such a text are cut where their bytes make up the pieces.
        """
        space = b" \t\n\v\f\r"
        within = [p[0] in space and p[-1] not in space for p in pieces]
        apart = [p for p, x in zip(pieces, within, strict=True) if not x]
        run = [p for p, x in zip(pieces, within, strict=True) if x]
        out = dict(zip(apart, self._bytes([p.decode() for p in apart]), strict=True))
        texts = [b"".join(run[i : i + self.joined]).decode() for i in range(0, len(run), self.joined)]
        if texts:
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(ends, np.cumsum([*map(len, run)])) + 1
            raw, width = ids.tobytes(), self.kind.itemsize
            cuts = [0, *(cuts * width).tolist()]
            out.update((p, raw[a:b]) for p, a, b in zip(run, cuts, cuts[1:], strict=False))
        return [out[p] for p in pieces]

    def _remembered(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces; those used again move to the newer generation before the older is dropped."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known, self.older = {}, self.known
        out = [*map(self.known.get, pieces)]
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            out[i] = self.older.get(pieces[i])
            if out[i] is None:
                new.append(i)
        for i, ids in zip(new, self._pieces([pieces[i] for i in new]), strict=True):
            out[i] = ids
        self.known.update((pieces[i], out[i]) for i in missing)
        return out

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The documents that are not cut into pieces."""
        raw, found = data.tobytes(), []
        for i in np.flatnonzero(self.odd[data]).tolist():
            after = next(rest for first, rest in ODD.items() if raw[i] in first)
            if any(raw.startswith(x, i + 1) for x in after):
                found.append(i)
        for token in self.added:
            i = raw.find(token)
            while i >= 0:
                found.append(i)
                i = raw.find(token, i + 1)
        return np.unique(np.searchsorted(offsets, found, side="right") - 1)

    def encode(self, column: pa.Array) -> list[bytes]:
        """Raw ids of each text (null: empty), each with the end id."""
        from resona.llm.hashing import column_bytes, word_hashes

        data, offsets = column_bytes(column)
        n = len(offsets) - 1
        if not self.cuttable:
            return [ids + self.end for ids in self._bytes([data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)])]
        if not len(data):
            return [self.end] * n
        cut = np.zeros(len(data) + 1, bool)
        space = self.space[data]
        cut[1:-1] = (~space[:-1] & space[1:]) | (self.letter[data[:-1]] & self.symbol[data[1:]])
        cut[offsets[1:]] = True
        ends = np.flatnonzero(cut[1:]) + 1
        starts = np.concatenate([[0], ends[:-1]])
        _, first, back = np.unique(word_hashes(data, starts, ends, 5), return_index=True, return_inverse=True)
        clash = (ends - starts != (ends - starts)[first[back]]) | (data[starts] != data[starts[first[back]]]) | (data[ends - 1] != data[ends[first[back]] - 1])
        bounds = np.searchsorted(ends, offsets, side="right")
        whole = np.union1d(self._whole(data, offsets), np.searchsorted(bounds, np.flatnonzero(clash), side="right") - 1)
        raw = data.tobytes()
        parts = self._remembered([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        flat, size = np.frombuffer(b"".join(parts), self.kind), sizes[back]
        to = np.cumsum(size)
        ids = flat[np.arange(int(to[-1])) + np.repeat((np.cumsum(sizes) - sizes)[back] - to + size, size)]
        at = np.concatenate([[0], to])[bounds].tolist()
        out = [ids[a:b].tobytes() + self.end for a, b in zip(at, at[1:], strict=False)]
        for i, one in zip(whole.tolist(), self._bytes([raw[offsets[i] : offsets[i + 1]].decode() for i in whole.tolist()]), strict=True):
            out[i] = one + self.end
        return out


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Writes the shards of one sorted partition (key, text, carried columns); yields ENTRY rows and what is carried."""
    from resona.llm.hashing import column_bytes, slices

    encoder = Encoder.of(tokenizer, end)
    width = encoder.kind.itemsize
    shard = TaskContext.get().partitionId() << PART_BITS
    held: list[bytes] = []
    rows: list[tuple] = []
    size, last, ordinal = 0, object(), 0

    carried: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        scratch.write_file(f"{folder}/shards/{shard:012d}.ids", held)
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
        more = pa.Table.from_batches(carried).combine_chunks()
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *(c.chunk(0) for c in more.columns)], ["shard", "addr", "no_key", "ordinal", "at", "n", *more.column_names])

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
        extra = batch.select(batch.schema.names[2:])
        for lo, hi in slices(column_bytes(texts)[1], 1 << 20):
            begin = lo
            for at, key, ids in zip(range(lo, hi), keys[lo:hi], encoder.encode(texts.slice(lo, hi - lo)), strict=True):
                ordinal = ordinal + 1 if key == last else 0
                last = key
                rows.append((shard, key or 0, key is None, ordinal, size // width, len(ids) // width))
                held.append(ids)
                size += len(ids)
                if size >= shard_bytes:
                    carried.append(extra.slice(begin, at + 1 - begin))
                    yield close()
                    held, rows, size, shard, begin = [], [], 0, shard + 1, at + 1
                    carried.clear()
            carried.append(extra.slice(begin, hi - begin))
    if rows:
        yield close()


def _address(*seed: int) -> Column:
    return F.xxhash64(*(F.lit(s) for s in seed), "no_key", "addr", "ordinal")


def build_index(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of a minimal perfect hash over distinct 64-bit hashes, and the slot of each.

    Each level is a bit array of twice the keys left; a key that is alone at its bit is placed there, the
    others go on. The slot is the number of set bits before the key's own. Keys left after LEVELS levels
    (equal hashes) have slots at the end, found by position in a list.
    """
    left, levels, slots, base = np.arange(len(hashes)), [], np.full(len(hashes), -1, np.int64), 0
    while len(left) and len(levels) < LEVELS:
        m = max(64, 2 * len(left))
        at = (mix(hashes[left] + U(len(levels) * 0x9E3779B9)) % U(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        placed = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[placed]] = base + rank[at[placed]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~placed]
    slots[left] = base + np.arange(len(left))
    return levels, slots


class Slots:
    """The way from hashes to slots: the bits of all levels in one row, with the number of set bits before every RANK of them.

    A key's slot is the number of set bits before its own, so it takes one directory entry and one run of RANK bits.
    """

    def __init__(self, sizes: np.ndarray, ranks: np.ndarray, bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.ranks, self.rest = sizes, bits.reshape(-1, RANK // 8), ranks, rest

    @classmethod
    def of(cls, levels: list[np.ndarray], rest: np.ndarray) -> Slots:
        flat = np.concatenate([*levels, np.zeros(0, bool)])
        bits = np.packbits(np.append(flat, np.zeros(-len(flat) % RANK, bool))).reshape(-1, RANK // 8)
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        return cls(np.array([len(x) for x in levels], "<i8"), (np.cumsum(ones) - ones).astype("<u4"), bits, rest.astype("<u8"))

    def _rank(self, at: np.ndarray) -> np.ndarray:
        row, place = at // RANK, at % RANK
        byte = np.arange(RANK // 8)[None, :]
        mask = np.where(byte < (place // 8)[:, None], 255, np.where(byte == (place // 8)[:, None], (0xFF00 >> (place % 8) & 0xFF)[:, None], 0))
        return self.ranks[row].astype(np.int64) + np.bitwise_count(self.bits[row] & mask.astype(np.uint8)).sum(1, dtype=np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; that of an unknown hash is any slot, or -1."""
        slots, left, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for k, m in enumerate(self.sizes.tolist()):
            at = base + (mix(hashes[left] + U(k * 0x9E3779B9)) % U(m)).astype(np.int64)
            hit = (self.bits[at // RANK, at % RANK // 8] >> (7 - at % 8) & 1) == 1
            slots[left[hit]] = self._rank(at[hit])
            left, base = left[~hit], base + m
        ones = int(self.ranks[-1]) + int(np.bitwise_count(self.bits[-1]).sum()) if len(self.ranks) else 0
        for i in left:
            where = np.flatnonzero(self.rest == hashes[i])
            slots[i] = ones + where[0] if len(where) else -1
        return slots


def _save_bucket(pdf: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Head, level sizes, directory, bits and rest of a bucket, then a record of fixed size for each slot."""
    hashes = pdf["h"].to_numpy().astype(U)
    levels, slots = build_index(hashes)
    order = np.argsort(slots)
    found = Slots.of(levels, hashes[order][sum(int(x.sum()) for x in levels) :])
    records = np.zeros(len(pdf), RECORD)
    records["mark"] = (pdf["h2"].to_numpy().astype(U) >> U(32)).astype(np.uint32)[order]
    for k in ("shard", "at", "n"):
        records[k] = pdf[k].to_numpy()[order]
    head = np.array([len(found.sizes), len(found.ranks), len(found.rest), len(pdf)], "<i8")
    scratch.write_file(f"{folder}/index/{int(pdf['bucket'].iloc[0]):08d}.mph", [x.tobytes() for x in (head, found.sizes, found.ranks, found.bits, found.rest, records)])
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "keys": [len(pdf)]})


def _look_up(pdf: pd.DataFrame, folder: str) -> pd.DataFrame:
    """The places of the keys of one bucket. A bucket's bits are some kilobytes; of its records only the pages with an asked one are read."""
    fs, path = scratch.open_fs(f"{folder}/index/{int(pdf['bucket'].iloc[0]):08d}.mph")
    if fs.get_file_info(path).type.name == "NotFound":
        return pdf.iloc[:0].assign(shard=0, at=0, n=0)[["addr", "no_key", "ordinal", "shard", "at", "n"]]
    with fs.open_input_file(path) as f:
        n_levels, n_ranks, n_rest, n_keys = np.frombuffer(f.read_at(32, 0), "<i8").tolist()
        at, parts = 32, []
        for kind, n in (("<i8", n_levels), ("<u4", n_ranks), ("u1", n_ranks * RANK // 8), ("<u8", n_rest)):
            size = n * np.dtype(kind).itemsize
            parts.append(np.frombuffer(f.read_at(size, at), kind))
            at += size
        slots = Slots(*parts).find(pdf["h"].to_numpy().astype(U))
        pdf, slots = pdf[slots >= 0], slots[slots >= 0]
        pages = np.unique(slots // PAGE)
        records = np.zeros(n_keys, RECORD)
        for run in np.split(pages, np.flatnonzero(np.diff(pages) > 1) + 1) if len(pages) else []:
            lo, hi = int(run[0]) * PAGE, min(n_keys, (int(run[-1]) + 1) * PAGE)
            records[lo:hi] = np.frombuffer(f.read_at((hi - lo) * RECORD.itemsize, at + lo * RECORD.itemsize), RECORD)
    same = records["mark"][slots] == (pdf["h2"].to_numpy().astype(U) >> U(32)).astype(np.uint32)
    pdf, records = pdf[same], records[slots[same]]
    return pdf.assign(**{k: records[k] for k in ("shard", "at", "n")})[["addr", "no_key", "ordinal", "shard", "at", "n"]]


def _read_shard(pdf: pd.DataFrame, folder: str, width: int) -> pd.DataFrame:
    fs, path = scratch.open_fs(f"{folder}/shards/{int(pdf['shard'].iloc[0]):012d}.ids")
    with fs.open_input_file(path) as f:
        ids = np.frombuffer(f.read(), f"<u{width}").astype("<u4")
    pdf = pdf.sort_values("at")
    return pdf.assign(ids=[ids[a : a + n].tobytes() for a, n in zip(pdf["at"], pdf["n"], strict=True)])[["addr", "no_key", "ordinal", "start", "n", "ids"]]


def _numbered(entries: DataFrame) -> DataFrame:
    """entries with ordinals that go on where a key's rows lie in several partitions; such a key is the last of one and the first of another."""
    part, place = F.shiftright("shard", PART_BITS).alias("part"), F.struct("no_key", "addr")
    ends = entries.groupBy(part).agg(F.min(F.struct(~F.col("no_key"), place)).alias("a"), F.max(F.struct(~F.col("no_key"), place)).alias("b"))
    first, last = (ends.select(F.col("part").alias(f"part_{x}"), F.col(f"{x}.col2.*")) for x in "ab")
    spread = first.join(last, ["no_key", "addr"]).where("part_a > part_b").select("no_key", "addr").distinct()
    sizes = entries.join(spread, ["no_key", "addr"]).groupBy("no_key", "addr", part).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("no_key", "addr").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("no_key", "addr", "part", F.coalesce(before, F.lit(0)).cast("int").alias("before"))
    joined = entries.withColumn("part", part).join(offsets, ["no_key", "addr", "part"], "left")
    return joined.withColumn("ordinal", F.col("ordinal") + F.coalesce("before", F.lit(0))).drop("part", "before")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, key: str = "doc_id", shard_bytes: int = 16 << 20, bucket_keys: int = 50_000, carry: Sequence[str] = ()) -> None:
    """Write a store of all texts into folder (a path that all executors share).

    tokenizer: file of a byte-level BPE for the tokenizers library. Each document ends with the id `end`.
    Null text: only the end id. Rows of one key are kept one after the other, ordered by text, numbered
    from 0; null keys form one such group, first of all. The rows of a very frequent key are spread over tasks by the
    first letters of their texts. Of the extra columns those in `carry` are kept beside the index. An empty table makes a
    store without shards.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(key).cast("long").alias("key"), "text", *(F.col(c).alias(f"carry_{c}") for c in carry))
    entry = StructType([*StructType.fromDDL(ENTRY).fields, *ordered.schema.fields[2:]])
    # the first letters only part the rows of one key; whole texts are sorted in the partition
    ordered = ordered.repartitionByRange("key", F.substring("text", 1, 32)).sortWithinPartitions("key", "text")
    entries = ordered.mapInArrow(lambda b: _write(b, folder, tokenizer, end, shard_bytes), entry)
    entries.write.option("compression", "zstd").parquet(f"{folder}/entries")
    entries = spark.read.schema(ENTRY).parquet(f"{folder}/entries")  # the carried columns are not read
    # one row a shard: few enough to number in one task
    manifest = entries.groupBy("shard").agg(F.sum("n").alias("ids")).selectExpr("shard", "ids", "sum(ids) OVER (ORDER BY shard) - ids AS before")
    manifest.write.parquet(f"{folder}/manifest")
    buckets = max(1, -(-entries.count() // bucket_keys))
    addressed = _numbered(entries).withColumns({"h": _address(1), "h2": _address(2, 2)}).withColumn("bucket", F.expr(f"pmod(h, {buckets})"))
    built = addressed.groupBy("bucket").applyInPandas(lambda pdf: _save_bucket(pdf, folder), "bucket long, keys long")
    built.write.parquet(f"{folder}/buckets")
    spark.range(1).select(F.lit(buckets).cast("long").alias("buckets")).coalesce(1).write.parquet(f"{folder}/meta")


def read_tokens(spark: SparkSession, folder: str, keys: DataFrame, tokenizer: str, end: int = 2, key: str = "doc_id") -> DataFrame:
    """Fetch documents by key through the index: key, ordinal, start (ids of all documents before), n_tokens, ids (binary, 32 bits each).

    keys: a column `key`; repeats ask once for each of the rows stored under it. Unknown keys give no row.
    """
    width = Encoder.of(tokenizer, end).kind.itemsize
    buckets = spark.read.schema("buckets long").parquet(f"{folder}/meta").first()[0]
    asked = keys.groupBy(F.col(key).cast("long").alias("key")).count().select(F.coalesce("key", F.lit(0)).alias("addr"), F.col("key").isNull().alias("no_key"), F.explode(F.expr("sequence(0, cast(count as int) - 1)")).alias("ordinal"))
    addressed = asked.withColumns({"h": _address(1), "h2": _address(2, 2)}).withColumn("bucket", F.expr(f"pmod(h, {buckets})"))
    places = addressed.groupBy("bucket").applyInPandas(lambda pdf: _look_up(pdf, folder), "addr long, no_key boolean, ordinal int, shard long, at long, n long")
    manifest = spark.read.schema("shard long, ids long, before long").parquet(f"{folder}/manifest")
    placed = places.join(manifest.select("shard", "before"), "shard").withColumn("start", F.col("before") + F.col("at"))
    out = placed.groupBy("shard").applyInPandas(lambda pdf: _read_shard(pdf, folder, width), "addr long, no_key boolean, ordinal int, start long, n long, ids binary")
    return out.select(F.when(~F.col("no_key"), F.col("addr")).alias(key), "ordinal", "start", F.col("n").alias("n_tokens"), "ids")


def token_store(docs: DataFrame, tokenizer: str, end: int = 2, key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """Write a store in the shared folder, then read every document back through its index, with the columns in `carry`."""
    spark = docs.sparkSession
    folder = scratch.folder(spark, "tokens")
    write_tokens(docs, folder, tokenizer, end, key, carry=carry)
    stored = _numbered(spark.read.parquet(f"{folder}/entries"))
    out = read_tokens(spark, folder, stored.select(F.when(~F.col("no_key"), F.col("addr")).alias(key)), tokenizer, end, key)
    if not carry:
        return out
    beside = stored.select(F.when(~F.col("no_key"), F.col("addr")).alias("_key"), F.col("ordinal").alias("_ordinal"), *(F.col(f"carry_{c}").alias(c) for c in carry))
    return out.join(beside, F.col(key).eqNullSafe(F.col("_key")) & (F.col("ordinal") == F.col("_ordinal"))).drop("_key", "_ordinal")
