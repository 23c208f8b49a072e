"""Vector code compression: codebooks of integer vectors, compared through per-dimension dictionaries of values.

Vectors are kept as blocks in which each dimension is a dictionary of its distinct integers and a code for each vector.
A round tabulates, dimension by dimension, the squared differences of every distinct integer to all entries of the
codebook; distances of a part are then rows gathered from these tables by the codes, and added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from resona.llm import scratch

BLOCK = 4096
SALT = 32


def coded(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension its distinct integers, ascending, and the place of each vector's value among them."""
    return [np.unique(column, return_inverse=True) for column in x.T]


def distances(dims: list[tuple[np.ndarray, np.ndarray]], codebook: np.ndarray) -> np.ndarray:
    """Squared distances of each part (its dimensions as dictionaries and codes) to all entries of a codebook."""
    reach = sum(int(max(values[-1] - entries.min(), entries.max() - values[0])) ** 2 for (values, _), entries in zip(dims, codebook.T, strict=True))
    if reach >= 1 << 63:
        raise OverflowError("a squared distance is too large for a long")
    kind = np.int32 if reach < 1 << 31 else np.int64
    out = np.zeros((len(dims[0][1]), len(codebook)), kind)
    for (values, codes), entries in zip(dims, codebook.T, strict=True):
        table = ((values[:, None] - entries[None, :]) ** 2).astype(kind)
        out += table[codes]
    return out


def assigned(dims: list[tuple[np.ndarray, np.ndarray]], books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Part, the nearest entry of each vector (ties: the lower) and the squared distance to it."""
    width = len(dims) // len(books)
    for part, book in enumerate(books):
        far = distances(dims[part * width : (part + 1) * width], book)
        best = far.argmin(1)
        yield part, best, far[np.arange(len(best)), best].astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    from resona.llm.packing import pack
    from resona.llm.vectors import integers, matrix

    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            part = batch.slice(lo, BLOCK)
            dims = coded(integers(matrix(part.column(1)), scale))
            size = [len(values) for values, _ in dims]
            tables = {"values": np.concatenate([v for v, _ in dims]) if dims else np.zeros(0, np.int64), "codes": np.concatenate([c for _, c in dims]).astype(np.uint16) if dims else np.zeros(0, np.uint16)}
            cells = {"rows": pack(pa.Table.from_batches([part.select([0, 2])])), "size": np.array(size, np.int32).tobytes(), **{k: v.tobytes() for k, v in tables.items()}}
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in cells.items()})


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[np.ndarray, np.ndarray]]]]:
    from resona.llm.packing import unpack

    for batch in batches:
        for r in batch.to_pylist():
            rows, size = unpack(r["rows"]), np.frombuffer(r["size"], np.int32)
            values = np.split(np.frombuffer(r["values"], np.int64), np.cumsum(size)[:-1])
            codes = np.frombuffer(r["codes"], np.uint16).reshape(len(size), -1)
            yield rows, list(zip(values, codes, strict=True))


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256: a row for each vector that is there and holds numbers only.

    Components become floor(scale * x); vectors are cut into `parts` equal parts (other lengths, mixed ones too, raise). Each part's
    codebook starts as that part of the vectors of the `entries` least keys (null keys last, equal ones by their vectors; fewer
    vectors, fewer entries) and is refined in `rounds` rounds: parts go to the nearest entry, entries become the floor of their
    parts' mean, those without parts stay. code: two hex digits a part. label_error: errors summed over equal labels, nulls
    together. Repeated rows stay, each with its own code; an empty table gives no rows; other columns are not read. Integers
    beyond what a long can hold the squares of raise. Codebooks (entries times dimensions) are what is sent about.
    """
    from resona.llm.vectors import integers, whole

    if not 1 < entries <= 256:
        raise ValueError("a code has two hex digits: 2 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.where(whole(vector)).select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    kinds = {"key": vectors.schema[key].dataType, "label": vectors.schema[label].dataType}
    schema = StructType([StructField(key, kinds["key"]), StructField("code", StringType()), StructField("error", LongType()), StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())])
    first = rows.select("key", "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()  # at most `entries` rows
    if not first:
        return spark.createDataFrame([], schema)
    if len({len(r.vector) for r in first}) > 1 or not len(first[0].vector) or len(first[0].vector) % parts:
        raise ValueError(f"vectors can't be cut into {parts} equal parts")
    d = len(first[0].vector)
    books = np.split(integers(np.array([r.vector for r in first], np.float64), scale), parts, axis=1)
    blocks = scratch.keep(rows.mapInArrow(lambda batches: _blocks(batches, scale), "rows binary, size binary, values binary, codes binary"), "vector-blocks")

    def sums(books: list[np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((parts, len(books[0]), d // parts), np.int64), np.zeros((parts, len(books[0])), np.int64)
            for _, dims in _opened(batches):
                if len(dims) != d:
                    raise ValueError(f"vectors of {d} and of {len(dims)} entries in one column")
                for part, best, _ in assigned(dims, books):
                    n[part] += np.bincount(best, minlength=len(books[part]))
                    order = np.argsort(best, kind="stable")
                    used, at = np.unique(best[order], return_index=True)
                    for i, (values, codes) in enumerate(dims[part * d // parts : (part + 1) * d // parts]):
                        total[part, used, i] += np.add.reduceat(values[codes[order]], at)
            part, entry = np.nonzero(n)
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        width = range(d // parts)
        each = blocks.mapInArrow(run, "part int, entry int, n long, total array<long>")
        return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in width]).alias("total"))

    for _ in range(rounds):
        means = sums(books).collect()  # at most an entry's sums for each entry of the codebooks
        books = [b.copy() for b in books]
        for r in means:
            books[r.part][r.entry] = np.array(r.total, np.int64) // r.n
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, dims in _opened(batches):
            code, error = np.zeros((len(held), parts), np.uint8), np.zeros(len(held), np.int64)
            for part, best, far in assigned(dims, books):
                code[:, part] = best
                error += far
            yield pa.RecordBatch.from_arrays([held.column("key").combine_chunks(), held.column("label").combine_chunks(), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["key", "label", "code", "error"])

    found = scratch.keep(blocks.mapInArrow(codes, StructType([StructField("key", kinds["key"]), StructField("label", kinds["label"]), StructField("code", StringType()), StructField("error", LongType())])), "vector-codes")
    # a hot label's rows are dealt over SALT tasks; its sum, one row, goes to each of them
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(SALT)).cast("int")).alias("a")
    joined = salted.join(by_label.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt")))
    return joined.select(F.col("a.key").alias(key), "a.code", "a.error", "b.label_error", F.lit(digest).alias("codebooks_sha256"))
